"""Language identification by Bayesian fusion of evidence.

The posterior of a language given a page multiplies

* the likelihood of its text under byte-pair models, one per language, trained on all rows
  with a language (counts are grouped over the whole table), tempered so that a long text
  weighs as ``FULL_BYTES`` bytes at most;
* the likelihood of the declared markup language, from a grouped table of declared against
  textual language with smoothing;
* a prior of the page's host: the textual languages of the host's other pages, smoothed
  towards its address suffix, that towards all pages. The page's own count is taken out.

``UNKNOWN`` stands for text of no language: it has the likelihood of even byte pairs. A row
is rejected when the best language is ``UNKNOWN`` or its posterior is under ``least``.

Texts are read in two passes of array arithmetic; what is joined to hosts and marks is a few
numbers per row. Hosts that hold most rows are counted map-side, and Spark may split their
partition in the join back.

Defined cases: a null text is an empty one, and an empty text has no textual likelihood, so
that declared language and host decide; an unknown declared language counts as none; a null
host is a host of its own; repeated rows are rows of their own; a table without any labelled
text knows no language and rejects all; an empty table gives an empty result; all columns of
the input are kept but those named like a new one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_words import LOWER, slices
from lexmill.session import bounded_batches, written

UNKNOWN = "und"
FULL_BYTES = 64
LEAST_POSTERIOR = 0.6
HOST_WEIGHT, SUFFIX_WEIGHT = 10.0, 20.0
# languages in one model: 256 KiB each
MOST_LANGUAGES = 512

# bytes other than letters count as one
_CLASS = np.where(
    ((LOWER >= 97) & (LOWER <= 122)) | (np.arange(256) >= 128), LOWER, 32
).astype(np.int64)


def _pairs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte pairs of each row as numbers, without pairs of two other bytes; offsets per row.

    Every text is read as if a space stood before it.
    """
    now = _CLASS[data]
    before = np.empty_like(now)
    if len(now):
        before[1:] = now[:-1]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        before[starts] = 32
    used = (now != 32) | (before != 32)
    kept = np.concatenate([[0], np.cumsum(used)])
    return (before * 256 + now)[used], kept[offsets]


def train_languages(texts: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities of byte pairs: languages x 65,536.

    ``texts`` has ``text`` and ``lang``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for start, data, offsets in slices(batch.column(0)):
                pairs, ends = _pairs(data, offsets)
                mine = np.array(langs[start : start + len(offsets) - 1], dtype=object)
                row_lang = np.repeat(mine, np.diff(ends))
                for lang in set(mine):
                    if lang not in held:
                        held[lang] = np.zeros(65536, np.int64)
                    held[lang] += np.bincount(pairs[row_lang == lang], minlength=65536)
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)),
                 pa.array(counts[at])],
                ["lang", "pair", "n"],
            )

    bounded_batches(texts.sparkSession)
    known = texts.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN))
    counts = written(
        known.select("text", "lang")
        .mapInArrow(count, "lang string, pair int, n long")
        .groupBy("lang", "pair")
        .agg(F.sum("n").alias("n")),
        "pairs",
    )
    langs = [r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages: map rare ones to a common name")
    langs.sort()
    # at most 65,536 rows per language
    rows = counts.toArrow()
    number = {lang: i for i, lang in enumerate(langs)}
    table = np.zeros((len(langs), 65536))
    lang_of = np.array([number[x] for x in rows["lang"].to_pylist()], np.int64)
    table[lang_of, rows["pair"].to_numpy()] = rows["n"].to_numpy()
    # of the next byte, given the one before
    shaped = table.reshape(len(langs), 256, 256) + 0.1
    return langs, np.log(shaped / shaped.sum(2, keepdims=True)).reshape(len(langs), 65536)


def _likelihoods(rows: DataFrame, text: str, model: np.ndarray) -> DataFrame:
    """``rows`` with ``text_ll`` instead of the text: per language, and last for no language."""
    spark = rows.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(model.astype(np.float32))

    @F.arrow_udf("array<double>")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = shared.value
        for column in columns:
            parts = []
            for _, data, offsets in slices(column):
                pairs, ends = _pairs(data, offsets)
                n = np.diff(ends)
                out = np.zeros((len(n), len(table) + 1))
                full = n > 0
                if full.any():
                    starts = ends[:-1][full]
                    for k, row in enumerate(table):
                        out[full, k] = np.add.reduceat(row[pairs], starts, dtype=np.float64)
                    out[full, -1] = -np.log(256.0) * n[full]
                    out[full] *= (np.minimum(n, FULL_BYTES) / np.maximum(n, 1))[full, None]
                parts.append(out)
            scores = np.concatenate(parts) if parts else np.zeros((0, len(table) + 1))
            width = scores.shape[1]
            ends = np.arange(0, scores.size + 1, width, dtype=np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends), pa.array(scores.ravel()))

    return rows.withColumn("text_ll", score(F.col(text)))


def _vector(columns: list[Column]) -> Column:
    return F.array(*columns)


def fuse_languages(
    rows: DataFrame,
    model: tuple[list[str], np.ndarray],
    text: Column,
    declared: Column,
    host: Column,
    suffix: Column,
    least: float = LEAST_POSTERIOR,
) -> DataFrame:
    """``rows`` with ``language``, ``posterior`` and ``rejected``."""
    langs, table = model
    kept = [c for c in rows.columns if c not in ("language", "posterior", "rejected")]
    if not langs:
        return rows.select(*kept).withColumns(
            {"language": F.lit(UNKNOWN), "posterior": F.lit(1.0), "rejected": F.lit(True)}
        )
    names, count = [*langs, UNKNOWN], len(langs) + 1
    given = F.lower(F.regexp_extract(F.coalesce(declared, F.lit("")), r"^\s*([A-Za-z]+)", 1))
    read = rows.select(
        F.struct(*kept).alias("_row"), text.alias("_text"), given.alias("_given"),
        F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(suffix, F.lit("")).alias("_suffix"),
    )
    scored = _likelihoods(read, "_text", table).drop("_text")
    no_text = F.forall("text_ll", lambda x: x == 0)
    best = F.array_position("text_ll", F.array_max("text_ll")).cast("int") - 1
    scored = scored.withColumn("_best", F.when(no_text, F.lit(None)).otherwise(best))
    # the texts are read once; what follows are joins on small tables
    scored = written(scored, "scored")

    def tally(key: list[str]) -> DataFrame:
        sums = [F.count(F.when(F.col("_best") == k, 1)).cast("double") for k in range(count)]
        return scored.groupBy(*key).agg(_vector(sums).alias("n"))

    hosts = written(tally(["_suffix", "_host"]), "hosts")
    add = lambda x, y: F.zip_with(x, y, lambda a, b: a + b)
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, b: a + b)
    scale = lambda x, w: F.transform(x, lambda a: a * w)
    sums = lambda c: _vector([F.sum(F.col(c)[k]) for k in range(count)])

    everywhere = hosts.agg(sums("n").alias("n")).first()["n"]
    grand = sum(x or 0.0 for x in everywhere) + count
    root = _vector([F.lit(((x or 0.0) + 1.0) / grand) for x in everywhere])
    suffixes = hosts.groupBy("_suffix").agg(sums("n").alias("s"))
    suffixes = suffixes.withColumn(
        "suffix_prior",
        scale(add("s", scale(root, SUFFIX_WEIGHT)), 1 / (total(F.col("s")) + SUFFIX_WEIGHT)),
    ).drop("s")
    priors = hosts.join(suffixes, "_suffix").select("_suffix", "_host", "n", "suffix_prior")

    # a declared language against the textual one
    marks = scored.filter("_best is not null").groupBy("_given", "_best").count()
    marks = marks.filter(F.col("_given").isin(*langs)).collect()  # at most languages squared
    reliable = np.full((len(langs), count), 0.5)
    reliable[np.arange(len(langs)), np.arange(len(langs))] += 4.0
    for r in marks:
        reliable[langs.index(r["_given"]), r["_best"]] += r["count"]
    reliable = np.log(reliable / reliable.sum(0, keepdims=True))
    declared_ll = F.create_map(
        *[x for i, lang in enumerate(langs) for x in (F.lit(lang), _vector([F.lit(float(v)) for v in reliable[i]]))]
    )

    own = _vector([F.when(F.col("_best") == k, 1.0).otherwise(0.0) for k in range(count)])
    others = F.zip_with("n", own, lambda a, b: a - b)
    prior = scale(
        add(others, scale(F.col("suffix_prior"), HOST_WEIGHT)), 1 / (total(others) + HOST_WEIGHT)
    )
    joined = scored.join(priors, ["_suffix", "_host"]).withColumn("_prior", prior)
    evenly = F.array_repeat(F.lit(0.0), count)
    logs = add(
        add("text_ll", F.transform("_prior", lambda p: F.log(p))),
        F.coalesce(F.try_element_at(declared_ll, F.col("_given")), evenly),
    )
    joined = joined.withColumn("_logs", logs).withColumn("_most", F.array_max("_logs"))
    weight = total(F.transform("_logs", lambda x: F.exp(x - F.col("_most"))))
    at = F.array_position("_logs", F.col("_most")).cast("int")
    language = F.element_at(F.array(*map(F.lit, names)), at)
    decided = joined.select("_row", language.alias("language"), (1 / weight).alias("posterior"))
    rejected = (F.col("language") == UNKNOWN) | (F.col("posterior") < least)
    return decided.select("_row.*", "language", "posterior", rejected.alias("rejected"))


def page_text(html: Column) -> Column:
    """Text of a page: without scripts, styles, comments and tags."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return F.regexp_replace(bare, r"<[^>]*>", " ")


def markup_language(html: Column) -> Column:
    return F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]+)", 1)
