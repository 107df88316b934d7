"""Quality classifier: a convolutional network over bytes, written in numpy.

Bytes are embedded, and learned filters slide over the whole text in steps of ``STEP``
bytes. Outputs are rectified and max-pooled over chunks of ``CHUNK`` bytes that overlap by
half. The mean, the largest and the smallest chunk value of each filter over the document
feed one logistic unit, so a text of any length gives one probability. Chunks are pooled by
halves, which makes every byte pass through the filters once.

Training fits a bounded sample of the labelled rows (``SAMPLE_ROWS``, whole texts), chosen by a
hash of the id. Each round every task trains a copy of the network on its own rows, and the
copies are averaged; the sample is the only data that training reads more than once.

Defined cases: a null text is an empty one; an empty text has all pooled values zero and gets
the probability learned for that; a long text is scored in pieces, whole; repeated rows get
equal scores; rows without label, or with labels that differ for one id, don't train; without
training rows every score is 0.5; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_words import text_bytes
from lexmill.session import bounded_batches, written

SAMPLE_ROWS = 4096

DIM, STEP, FILTERS = 8, 4, 32
WIDTH = 2 * STEP
HALF = 128
CHUNK = 2 * HALF
_PER_HALF = HALF // STEP
_BLOCK_HALVES = 1024
_INPUTS = WIDTH * DIM


class Network(NamedTuple):
    embed: np.ndarray  # 256 x DIM; byte 0 pads and stays zero
    filters: np.ndarray  # _INPUTS x FILTERS
    unit: np.ndarray  # 3 * FILTERS
    bias: np.ndarray  # 1


def new_network(seed: int = 7) -> Network:
    draw = np.random.Generator(np.random.PCG64(seed))
    embed = draw.normal(0, 0.5, (256, DIM))
    embed[0] = 0
    filters = draw.normal(0, np.sqrt(2 / _INPUTS), (_INPUTS, FILTERS))
    unit = draw.normal(0, 0.1, 3 * FILTERS)
    parts = (embed, filters, unit, np.zeros(1))
    return Network(*[p.astype(np.float32) for p in parts])


def _padded(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts laid out in halves, each after ``STEP`` zero bytes, so that no filter sees two
    texts; and the number of halves per text."""
    halves = np.array([(len(t) + STEP - 1) // HALF + 1 for t in texts])
    data = np.zeros(halves.sum() * HALF + STEP, np.uint8)
    at = 0
    for text, n in zip(texts, halves, strict=True):
        data[at + STEP : at + STEP + len(text)] = text
        at += n * HALF
    return data, halves


def _pooled(net: Network, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest rectified output per half and filter, and its position in the half."""
    n = (len(data) - STEP) // HALF
    values = np.empty((n, FILTERS), np.float32)
    where = np.empty((n, FILTERS), np.int32)
    cut = STEP * DIM
    for a in range(0, n, _BLOCK_HALVES):
        b = min(a + _BLOCK_HALVES, n)
        steps = net.embed[data[a * HALF : b * HALF + STEP]].reshape(-1, cut)
        out = steps[:-1] @ net.filters[:cut]
        out += steps[1:] @ net.filters[cut:]
        out = out.reshape(b - a, _PER_HALF, FILTERS)
        where[a:b] = out.argmax(axis=1)
        values[a:b] = np.maximum(np.take_along_axis(out, where[a:b, None], 1)[:, 0], 0)
    return values, where


class _Chunks(NamedTuple):
    values: np.ndarray  # chunks x FILTERS
    second: np.ndarray  # whether the later half holds the largest value
    first: np.ndarray  # number of the earlier half
    starts: np.ndarray  # first chunk of each text
    counts: np.ndarray


def _chunked(values: np.ndarray, halves: np.ndarray) -> _Chunks:
    ends = np.cumsum(halves)
    counts = np.maximum(halves - 1, 1)
    last = np.zeros(len(values), bool)
    last[ends - 1] = True
    last[ends[halves == 1] - 1] = False  # a single half is a chunk
    first = np.flatnonzero(~last)
    alone = np.zeros(len(values), bool)
    alone[ends[halves == 1] - 1] = True
    follow = np.where(alone[first], first, np.minimum(first + 1, len(values) - 1))
    x, y = values[first], values[follow]
    return _Chunks(np.maximum(x, y), y > x, first, np.cumsum(counts) - counts, counts)


def _features(chunks: _Chunks) -> np.ndarray:
    v, s = chunks.values, chunks.starts
    return np.concatenate(
        [np.add.reduceat(v, s) / chunks.counts[:, None].astype(np.float32),
         np.maximum.reduceat(v, s), np.minimum.reduceat(v, s)], axis=1,
    )


def _logits(net: Network, features: np.ndarray) -> np.ndarray:
    return (features @ net.unit + net.bias).astype(np.float64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def score_texts(net: Network, texts: list[np.ndarray]) -> np.ndarray:
    data, halves = _padded(texts)
    values, _ = _pooled(net, data)
    return _sigmoid(_logits(net, _features(_chunked(values, halves))))


def gradients(net: Network, texts: list[np.ndarray], labels: np.ndarray) -> tuple[float, Network]:
    """Mean logistic loss of a batch and its gradient."""
    data, halves = _padded(texts)
    values, where = _pooled(net, data)
    chunks = _chunked(values, halves)
    features = _features(chunks)
    p = _sigmoid(_logits(net, features))
    n = len(texts)
    loss = -np.mean(labels * np.log(p + 1e-9) + (1 - labels) * np.log(1 - p + 1e-9))
    d = ((p - labels) / n).astype(np.float32)
    to_features = d[:, None] * net.unit
    mean, most, least = np.split(to_features, 3, axis=1)
    text = np.repeat(np.arange(n), chunks.counts)
    d_chunk = (mean / chunks.counts[:, None])[text].astype(np.float32)
    # the chunk that holds the largest (smallest) value gets that part
    columns = np.arange(FILTERS)
    for part, at in ((most, np.maximum), (least, np.minimum)):
        hit = chunks.values == at.reduceat(chunks.values, chunks.starts)[text]
        order = np.where(hit, np.arange(len(text))[:, None], len(text))
        chosen = np.minimum.reduceat(order, chunks.starts)
        d_chunk[chosen, columns] += part
    d_half = np.zeros_like(values)
    np.add.at(d_half, chunks.first, np.where(chunks.second, 0, d_chunk))
    follow = np.minimum(chunks.first + 1, len(values) - 1)
    np.add.at(d_half, follow, np.where(chunks.second, d_chunk, 0))
    d_half[values <= 0] = 0
    # the window of bytes behind each pooled value
    h, f = np.nonzero(d_half)
    g = d_half[h, f]
    bytes_at = (h * HALF + where[h, f] * STEP)[:, None] + np.arange(WIDTH)
    window = data[bytes_at]
    inputs = net.embed[window].reshape(len(h), _INPUTS)
    d_filters = np.zeros((FILTERS, _INPUTS), np.float32)
    order = np.argsort(f, kind="stable")
    weighted = (inputs * g[:, None])[order]
    if len(f):
        used, starts = np.unique(f[order], return_index=True)
        d_filters[used] = np.add.reduceat(weighted, starts)
    d_inputs = (net.filters.T[f] * g[:, None]).reshape(-1, DIM)
    flat = window.ravel()
    d_embed = np.stack(
        [np.bincount(flat, weights=d_inputs[:, k], minlength=256) for k in range(DIM)], axis=1
    )
    d_embed[0] = 0
    return float(loss), Network(
        d_embed.astype(np.float32), d_filters.T.copy(), features.T @ d, d.sum(keepdims=True)
    )


def _texts(column) -> list[np.ndarray]:
    data, offsets = text_bytes(column)
    return [data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _train_rows(
    net: Network, texts: list, labels: np.ndarray, seed: int, rate: float, batch: int, passes: int
) -> Network:
    """Adam over a task's rows."""
    draw = np.random.Generator(np.random.PCG64(seed))
    parts = [p.astype(np.float64) for p in net]
    m = [np.zeros_like(p) for p in parts]
    v = [np.zeros_like(p) for p in parts]
    step = 0
    for _ in range(passes):
        order = draw.permutation(len(texts))
        for a in range(0, len(order), batch):
            pick = order[a : a + batch]
            current = Network(*[p.astype(np.float32) for p in parts])
            _, grads = gradients(current, [texts[i] for i in pick], labels[pick])
            step += 1
            for k, g in enumerate(grads):
                g = g.astype(np.float64) + 1e-5 * parts[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                scale = np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8
                parts[k] -= rate * m[k] / (1 - 0.9**step) / scale
            parts[0][0] = 0
    return Network(*[p.astype(np.float32) for p in parts])


def _packed(net: Network) -> bytes:
    return np.concatenate([p.ravel() for p in net]).astype(np.float32).tobytes()


def _unpacked(blob: bytes) -> Network:
    flat, parts, at = np.frombuffer(blob, np.float32), [], 0
    for p in new_network():
        parts.append(flat[at : at + p.size].reshape(p.shape))
        at += p.size
    return Network(*parts)


def bounded_sample(
    docs: DataFrame, labels: DataFrame, most: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, text, label`` of about ``most`` labelled rows at most, chosen by a hash.

    ``labels`` has ``doc_id, label``; ids with differing labels are left out.
    """
    sure = (
        labels.filter("doc_id is not null and label is not null")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("_most"))
        .filter("label = _most")
        .drop("_most")
    )
    n = sure.count()
    share = min(1.0, most / max(n, 1))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    chosen = sure.filter(draw < int(share * (1 << 30)))
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"))
    # about ``most`` rows of 12 bytes
    return texts.join(F.broadcast(chosen), F.col("_id") == F.col("doc_id")).select(
        "doc_id", "text", "label"
    )


def _trainer(start: bytes, turn: int, rate: float, batch: int):
    def train(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        by = [("doc_id", "ascending"), ("text", "ascending")]
        rows = pa.Table.from_batches(list(batches)).sort_by(by)
        texts = _texts(rows.column("text"))
        labels = rows.column("label").to_numpy().astype(np.float64)
        seed = 1000 * turn + key[0].as_py()
        fitted = _train_rows(_unpacked(start), texts, labels, seed, rate, batch, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array([_packed(fitted)], pa.binary()), pa.array([len(texts)], pa.int64())],
            ["net", "n"],
        )

    return train


def train_quality(
    docs: DataFrame,
    labels: DataFrame,
    sample_rows: int = SAMPLE_ROWS,
    tasks: int = 8,
    rounds: int = 7,
    rate: float = 0.015,
    batch: int = 16,
) -> Network | None:
    """A network fitted on ``labels`` (``doc_id``, ``label`` 0 or 1), or None without rows."""
    sample = bounded_sample(docs, labels, sample_rows)
    task = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(tasks)).cast("int")
    spread = written(sample.withColumn("task", task), "sample")
    net = None
    for turn in range(rounds):
        train = _trainer(_packed(net or new_network()), turn, rate * 0.85**turn, batch)
        # one row of 40 kB per task
        copies = spread.groupBy("task").applyInArrow(train, "net binary, n long").collect()
        if not copies:
            return None
        copies.sort(key=lambda r: bytes(r["net"]))
        total = sum(r["n"] for r in copies)
        mean = sum(np.frombuffer(r["net"], np.float32) * (r["n"] / total) for r in copies)
        net = _unpacked(mean.astype(np.float32).tobytes())
    return net


def score_quality(docs: DataFrame, net: Network | None, text: str = "text") -> DataFrame:
    """``docs`` with a column ``score``, in place of one of that name."""
    kept = [c for c in docs.columns if c != "score"]
    if net is None:
        return docs.select(*kept, F.lit(0.5).alias("score"))
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(_packed(net))  # 40 kB

    @F.arrow_udf("double")
    def score(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = _unpacked(shared.value)
        for column in columns:
            out, held, size = [], [], 0
            for t in _texts(column):
                held.append(t)
                size += len(t)
                if size > 1 << 19:
                    out.append(score_texts(model, held))
                    held, size = [], 0
            if held:
                out.append(score_texts(model, held))
            yield pa.array(np.concatenate(out) if out else np.zeros(0))

    return docs.select(*kept, score(F.col(text)).alias("score"))
