"""Toxicity severity by cumulative-link ordinal regression on sparse word features.

A text's features are its words (runs of letters and digits, A-Z lower-cased) and the beginnings
of longer ones (``PREFIXES`` bytes; insults come in compounds), with the logarithm of one plus
their count. One weight vector ``w`` serves all thresholds
``t_0 < t_1 < ...``: the probability of a grade above ``k`` is ``sigmoid(w.x - t_k)``, and the
expected severity is the sum of these probabilities. An L1 penalty keeps few words.

The model is fitted in one task on a bounded sample of the labelled rows (``SAMPLE_ROWS``,
whole texts, chosen by a hash of the id) and on words of at least ``LEAST_ROWS`` of its rows;
scoring reads every whole text.

Weights are not negative: words only add to severity. The severity from which a text has a grade
is the least that at most ``FALSE_ALARMS`` of clean rows reach, each judged by a fit to the half of
the sample without it; the weights are then fitted to the whole sample.

Defined cases: a null text is an empty one; a text without known words has the severity that
the thresholds alone give, the least of all; repeated rows score alike; rows without grade, or with grades that
differ for one id, don't train; with fewer than two grades in the sample every severity is
the only grade, or 0; an empty table gives an empty result; all columns of the input are kept
but those named like a new one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_words import LOWER, PUNCTUATED, Words, mix64, words_of
from lexmill.llm.quality_cnn import bounded_sample
from lexmill.session import written

SAMPLE_ROWS = 8192
PREFIXES = (4, 5, 6, 7, 8)
LEAST_ROWS = 5
PENALTY = 3e-4
STEPS = 400
# share of clean held-out rows that may get a grade, and the fewest to judge that by
FALSE_ALARMS, LEAST_CLEAN = 0.005, 200
# a word marks toxic rows if it is this much more frequent in them
MARK_RATIO = 8.0


class Ordinal(NamedTuple):
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    thresholds: np.ndarray  # rising, one less than grades
    cut: float = 0.5  # severity from which a text has a grade


class _Rows(NamedTuple):
    """Sparse rows: entries ``starts[i]:starts[i + 1]`` are row ``i``."""

    starts: np.ndarray
    columns: np.ndarray
    values: np.ndarray

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(self.values * w[self.columns])])
        return sums[self.starts[1:]] - sums[self.starts[:-1]]

    def take(self, rows: np.ndarray) -> _Rows:
        sizes = np.diff(self.starts)[rows]
        ends = np.cumsum(sizes)
        at = np.arange(sizes.sum()) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return _Rows(np.concatenate([[0], ends]), self.columns[at], self.values[at])

    def back(self, d: np.ndarray, n: int) -> np.ndarray:
        spread = np.repeat(d, np.diff(self.starts))
        return np.bincount(self.columns, weights=self.values * spread, minlength=n)


def _features(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(hashes per word, which words have the feature): the words, and their beginnings."""
    every = np.ones(len(words.hashes), bool)
    out = [(words.hashes, every)]
    data = np.concatenate([words.data, np.zeros(max(PREFIXES), np.uint8)])
    value = np.zeros(len(words.hashes), np.uint64)
    for n in range(max(PREFIXES)):
        value |= LOWER[data[words.begin + n]].astype(np.uint64) << np.uint64(8 * n)
        if n + 1 in PREFIXES:
            longer = words.end - words.begin > n + 1
            out.append((mix64(value ^ np.uint64(0x9D39247E33776D41 + n)), longer))
    return out


def _word_counts(column) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(row, distinct feature hashes, counts)."""
    for words in words_of(column, PUNCTUATED):
        kinds = _features(words)
        for i in range(words.rows):
            part = slice(words.first[i], words.first[i + 1])
            found = np.concatenate([h[part][own[part]] for h, own in kinds])
            yield words.start + i, *np.unique(found, return_counts=True)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss_parts(margin: np.ndarray, grade: np.ndarray, thresholds: np.ndarray):
    """Derivatives of the mean loss by margin and by thresholds."""
    n, edges = len(margin), np.concatenate([[-np.inf], thresholds, [np.inf]])
    upper = _sigmoid(edges[grade + 1] - margin)
    lower = _sigmoid(edges[grade] - margin)
    p = np.maximum(upper - lower, 1e-12)
    du, dl = upper * (1 - upper), lower * (1 - lower)
    du[grade == len(thresholds)] = 0
    dl[grade == 0] = 0
    by_margin = (du - dl) / p / n
    by_threshold = np.bincount(grade, weights=-du / p / n, minlength=len(edges) - 1)[:-1]
    by_threshold += np.bincount(grade, weights=dl / p / n, minlength=len(edges) - 1)[1:]
    return by_margin, by_threshold


def fit_ordinal(
    rows: _Rows,
    grades: np.ndarray,
    features: int,
    penalty: float = PENALTY,
    steps: int = STEPS,
    least: float = -np.inf,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights, ``least`` or more, and thresholds by accelerated proximal gradient steps."""
    top = int(grades.max())
    shares = np.array([(grades > k).mean() for k in range(top)])
    t = np.log((1 - shares) / np.maximum(shares, 1e-6))
    w = np.zeros(features)
    v = np.random.Generator(np.random.PCG64(5)).normal(size=features)
    for _ in range(20):  # largest eigenvalue, for the step's length
        v = rows.back(rows.dot(v / np.linalg.norm(v)), features)
    rate = 1 / (0.5 * np.linalg.norm(v) / len(grades) + 1)
    ahead_w, ahead_t, pace = w, t, 1.0
    for _ in range(steps):
        by_margin, by_threshold = _loss_parts(rows.dot(ahead_w), grades, ahead_t)
        step = ahead_w - rate * rows.back(by_margin, features)
        new_w = np.maximum(np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), least)
        new_t = np.maximum.accumulate(ahead_t - rate * by_threshold + 1e-6 * np.arange(top))
        faster = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead_w = new_w + (pace - 1) / faster * (new_w - w)
        ahead_t = np.maximum.accumulate(new_t + (pace - 1) / faster * (new_t - t))
        w, t, pace = new_w, new_t, faster
    return w, t


def _counted_sample(sample: DataFrame) -> DataFrame:
    """``label, words, counts`` of each row, the last two as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, counts = [], []
            for _, found, many in _word_counts(batch.column(1)):
                words.append(found.tobytes())
                counts.append(many.astype(np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(words, pa.binary()),
                 pa.array(counts, pa.binary())],
                ["doc_id", "label", "words", "counts"],
            )

    return sample.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(
        run, "doc_id long, label int, words binary, counts binary"
    )


def severity_grades(counts: list[np.ndarray], words: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 for rows that are only marked toxic or not: 0 is not toxic; toxic rows
    are split at the terciles of how many of their words are much more frequent in toxic rows.
    """
    every, row_count = np.unique(np.concatenate(words), return_counts=True)
    marked_rows = np.concatenate([w for w, t in zip(words, toxic, strict=True) if t] or [every[:0]])
    inside, inside_count = np.unique(marked_rows, return_counts=True)
    toxic_rows = np.zeros(len(every))
    toxic_rows[np.searchsorted(every, inside)] = inside_count
    n1, n0 = max(int(toxic.sum()), 1), max(int((toxic == 0).sum()), 1)
    ratio = ((toxic_rows + 0.5) / n1) / ((row_count - toxic_rows + 0.5) / n0)
    marks = every[(row_count >= LEAST_ROWS) & (ratio >= MARK_RATIO)]
    heavy = np.array(
        [c[np.isin(w, marks, assume_unique=True)].sum() for w, c in zip(words, counts, strict=True)]
    )
    grades = np.zeros(len(toxic), np.int64)
    if toxic.any():
        cuts = np.quantile(heavy[toxic == 1], [1 / 3, 2 / 3])
        grades[toxic == 1] = 1 + np.searchsorted(cuts, heavy[toxic == 1], side="left")
    return grades


def expected_severity(margin: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """The sum of the probabilities of a grade above each threshold."""
    return _sigmoid(margin[:, None] - thresholds[None, :]).sum(axis=1)


def least_severity(rows: _Rows, grades: np.ndarray, features: int) -> float:
    """Severity that few clean rows reach, each judged by a fit to the half without it."""
    if (grades == 0).sum() < LEAST_CLEAN:
        return 0.5
    found = []
    for half in (0, 1):
        seen = np.arange(len(grades)) % 2 == half
        if len(np.unique(grades[seen])) < 2:
            return 0.5
        weights, thresholds = fit_ordinal(
            rows.take(np.flatnonzero(seen)), grades[seen], features, least=0.0
        )
        clean = np.flatnonzero(~seen & (grades == 0))
        found.append(expected_severity(rows.take(clean).dot(weights), thresholds))
    severity = np.concatenate(found)
    return min(0.5, float(np.quantile(severity, 1 - FALSE_ALARMS, method="higher")) + 1e-6)


def train_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    binary: bool = False,
) -> Ordinal:
    """A model of the grades ``label`` (0, 1, ...) of ``labels``. With ``binary`` the labels
    only say whether a row is toxic, and grades are derived from the sample's words."""
    sample = written(_counted_sample(bounded_sample(docs, labels, sample_rows)), "sample")

    def fit(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).sort_by([("doc_id", "ascending"), ("words", "ascending")])
        words = [np.frombuffer(x.as_buffer(), np.uint64) for x in rows["words"]]
        counts = [np.frombuffer(x.as_buffer(), np.uint32) for x in rows["counts"]]
        grades = rows["label"].to_numpy().astype(np.int64)
        if binary:
            grades = severity_grades(counts, words, grades)
        every, row_count = np.unique(np.concatenate(words), return_counts=True)
        every = every[row_count >= LEAST_ROWS]
        place = [np.searchsorted(every, w) for w in words]
        known = [
            (p < len(every)) & (every[np.minimum(p, len(every) - 1)] == w) if len(every) else p < 0
            for p, w in zip(place, words, strict=True)
        ]
        sparse = _Rows(
            np.concatenate([[0], np.cumsum([k.sum() for k in known])]),
            np.concatenate([p[k] for p, k in zip(place, known, strict=True)]),
            np.log1p(np.concatenate([c[k] for c, k in zip(counts, known, strict=True)])),
        )
        cut = 0.5
        if len(np.unique(grades)) > 1:
            cut = least_severity(sparse, grades, len(every))
            # words only add to severity: a text without any is the least severe
            weights, thresholds = fit_ordinal(sparse, grades, len(every), least=0.0)
        else:  # the only grade for sure
            weights, thresholds = np.zeros(len(every)), np.full(int(grades[0]), -40.0)
        used = weights != 0
        yield pa.RecordBatch.from_arrays(
            [
                *(pa.array([x.tobytes()], pa.binary()) for x in (every[used], weights[used], thresholds)),
                pa.array([cut]),
            ],
            ["words", "weights", "thresholds", "cut"],
        )

    # one task for a sample of bounded size; a row of some kilobytes comes back
    fitted = (
        sample.groupBy(F.lit(0).alias("all"))
        .applyInArrow(fit, "words binary, weights binary, thresholds binary, cut double")
        .collect()
    )
    if not fitted:
        return Ordinal(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))
    row = fitted[0]
    return Ordinal(
        np.frombuffer(row["words"], np.uint64), np.frombuffer(row["weights"]),
        np.frombuffer(row["thresholds"]), row["cut"],
    )


def margins(model: Ordinal, column) -> np.ndarray:
    """``w.x`` of each text."""
    out = []
    known = model.words
    for words in words_of(column, PUNCTUATED):
        scores = np.zeros(words.rows)
        if len(known) and len(words.hashes):
            entries = []
            for hashes, own in _features(words):
                place = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                hit = np.flatnonzero((known[place] == hashes) & own)
                row = np.searchsorted(words.first, hit, side="right") - 1
                entries.append(row * len(known) + place[hit])
            entry, many = np.unique(np.concatenate(entries), return_counts=True)
            scores = np.bincount(
                entry // len(known),
                weights=model.weights[entry % len(known)] * np.log1p(many),
                minlength=words.rows,
            )
        out.append(scores)
    return np.concatenate(out) if out else np.zeros(0)


def score_toxicity(docs: DataFrame, model: Ordinal, text: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected grade), ``grade`` (its nearest, from the model's least
    severity on at least 1, below it 0) and ``toxic`` (whether the grade is above 0)."""
    new = ("severity", "grade", "toxic")
    kept = [c for c in docs.columns if c not in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # some kilobytes

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        fitted = shared.value
        for column in columns:
            yield pa.array(expected_severity(margins(fitted, column), fitted.thresholds))

    scored = docs.select(*kept, score(F.col(text)).alias("severity"))
    nearest = F.greatest(F.round("severity").cast("int"), F.lit(1))
    grade = F.when(F.col("severity") >= model.cut, nearest).otherwise(0)
    return scored.select(*kept, "severity", grade.alias("grade"), (grade > 0).alias("toxic"))
