"""TF-IDF over a word block and a character block.

A document's n-grams are counted in the task that reads it and never leave it as rows: a text is
neither shuffled nor expanded. What is shuffled is the vocabulary count, a row per term and run of
documents. Most terms of a corpus occur in one document only; a first pass marks hashed terms as
seen once or seen again in two bit arrays of fixed size, and a term that is not marked as seen again
is dropped where it is found. Collisions only keep more, so the counts stay exact. The frozen
vocabulary is as large as its caps allow; it is sent to every worker as sorted hashes, and weighing,
normalising and packing are one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from lexmill import fixed_values as fv
from lexmill.functions.grams import (
    Grams,
    run_grams,
    run_hashes,
    runs_of_rows,
)
from lexmill.functions.ngrams import (
    BLOCKS,
    CHAR_BLOCK,
    WORD_BLOCK,
    spaced_words,
    word_tokens,
)
from lexmill.session import bounded_batches, broadcast_if_small, numbered, spread, written

# Bits of each of the two arrays that mark terms as seen once and seen again (4 MB an array).
FILTER_BITS = 1 << 25
# Parts in which tasks send them (64 kB).
_FILTER_PART = 1 << 16
# Terms of a vocabulary sent to every worker at once (200 MB).
MAPPED_TERMS = 8_000_000
# Bytes of words whose terms are counted together inside a task.
_RUN_BYTES = 1 << 21
_COUNTS = "block string, n int, term string, df long, tf long"


@dataclass(frozen=True)
class TfidfConfig:
    ngram_max: int = fv.NGRAM_MAX
    min_df: int = fv.MIN_DF
    max_df: float = fv.MAX_DF
    sublinear_tf: bool = True
    word_max_features: int = fv.WORD_MAX_FEATURES
    char_max_features: int = fv.CHAR_MAX_FEATURES

    def limits(self, block: str) -> tuple[int, float, int]:
        """Lowest document count, highest document share and size cap of a block."""
        if block == WORD_BLOCK:
            return self.min_df, self.max_df, self.word_max_features
        return (
            max(fv.CHAR_MIN_DF_FLOOR, self.min_df),
            min(fv.CHAR_MAX_DF_CEILING, self.max_df + fv.CHAR_MAX_DF_SLACK),
            self.char_max_features,
        )

    def sublinear(self, block: str) -> bool:
        return self.sublinear_tf if block == WORD_BLOCK else True


# --- counting --------------------------------------------------------------------------


def _tokenized(df: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """``keys`` and the document's words of both blocks.

    A file with fewer splits than cores is spread over them first; larger tables stay where
    they are read.
    """
    # a worker holds a batch of words several times over
    bounded_batches(df.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = spread(df.select(*keys, text.alias("_text")))
    return rows.select(
        *keys,
        word_tokens(F.col("_text")).alias("_words"),
        spaced_words(F.col("_text")).alias("_pieces"),
    )


def _documents(batch: pa.RecordBatch, most: int) -> Iterator[tuple[range, tuple[Grams, ...]]]:
    """Runs of rows with their terms, by block; the last two columns are the words."""
    words, pieces = batch.columns[-2:]
    for rows in runs_of_rows(words, _RUN_BYTES):
        yield rows, run_grams(words, pieces, rows, most)


def _sums(grams: Grams) -> tuple[np.ndarray, np.ndarray]:
    """Documents of each term, and how often it occurs in them."""
    df, tf = np.zeros((2, len(grams.hashes)), np.int64)
    for ids, times in grams.documents():
        df[ids] += 1
        tf[ids] += times
    return df, tf


def _marker(most: int, least: Sequence[int]):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = np.zeros(FILTER_BITS, bool), np.zeros(FILTER_BITS, bool)
        for batch in batches:
            for _, blocks in _documents(batch, most):
                for grams, low in zip(blocks, least, strict=True):
                    if low > 1:
                        df, _ = _sums(grams)
                        cells = grams.hashes % np.uint64(FILTER_BITS)
                        again[cells] |= once[cells]
                        again[cells[df > 1]] = True
                        once[cells] = True
        for i in range(0, FILTER_BITS, _FILTER_PART * 8):
            part = slice(i, i + _FILTER_PART * 8)
            if once[part].any():
                packed = [np.packbits(x[part]).tobytes() for x in (once, again)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i], pa.int32()), *(pa.array([p], pa.binary()) for p in packed)],
                    ["part", "once", "again"],
                )

    return mark


def _merged(table: pa.Table) -> pa.Table:
    once = again = None
    for a, b in zip(table.column("once"), table.column("again"), strict=True):
        a, b = (np.frombuffer(x.as_buffer(), np.uint8) for x in (a, b))
        if once is None:
            once, again = a, b
        else:
            again = again | b | (once & a)
            once = once | a
    return pa.table(
        {
            "part": table.column("part").slice(0, 1),
            "once": pa.array([once.tobytes()], pa.binary()),
            "again": pa.array([again.tobytes()], pa.binary()),
        }
    )


def seen_again(tokens: DataFrame, most: int, least: Sequence[int]) -> np.ndarray | None:
    """Marks of the hashed terms that may be in two documents or more; None if all are wanted."""
    if max(least) < 2:
        return None
    schema = "part int, once binary, again binary"
    # an array per task: no more tasks than run at once
    cores = tokens.sparkSession.sparkContext.defaultParallelism
    marks = tokens.coalesce(cores).mapInArrow(_marker(most, least), schema)
    lanes = max(1, int(cores**0.5))
    marks = marks.withColumn("lane", F.pmod(F.xxhash64("once"), F.lit(lanes)))
    marks = marks.groupBy("part", "lane").applyInArrow(_merged, schema)
    marks = marks.groupBy("part").applyInArrow(_merged, schema)
    bits = np.zeros(FILTER_BITS // 8, np.uint8)
    for r in marks.select("part", "again").collect():  # FILTER_BITS at most
        bits[r["part"] // 8 :][:_FILTER_PART] = np.frombuffer(r["again"], np.uint8)
    return bits


def _wanted(hashes: np.ndarray, bits: np.ndarray | None, low: int) -> np.ndarray:
    if bits is None or low < 2:
        return np.ones(len(hashes), bool)
    cells = (hashes % np.uint64(FILTER_BITS)).astype(np.int64)
    return (bits[cells >> 3] >> (7 - (cells & 7)).astype(np.uint8)) & 1 == 1


def _summer(shared, most: int, least: Sequence[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for batch in batches:
            for _, blocks in _documents(batch, most):
                for block, grams, low in zip(BLOCKS, blocks, least, strict=True):
                    own = np.flatnonzero(_wanted(grams.hashes, bits, low))
                    if not len(own):
                        continue
                    df, tf = _sums(grams)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([block]).take(pa.array(np.zeros(len(own), np.int32))),
                            pa.array(grams.sizes[own]),
                            grams.strings(own),
                            pa.array(df[own]),
                            pa.array(tf[own]),
                        ],
                        ["block", "n", "term", "df", "tf"],
                    )

    return count


def term_stats(
    df: DataFrame,
    ngram_max: int = fv.NGRAM_MAX,
    text_col: str = "text",
    least: Sequence[int] = (1, 1),
) -> DataFrame:
    """Document and corpus count per term: ``block, n, term, df, tf``.

    ``least`` is the lowest document count wanted of a word and of a character term; terms below
    it may be left out, most of them before any shuffle.
    """
    tokens = _tokenized(df, [], text_col)
    bits = seen_again(tokens, ngram_max, least)
    shared = df.sparkSession.sparkContext.broadcast(bits)
    counted = tokens.mapInArrow(_summer(shared, ngram_max, least), _COUNTS)
    stats = counted.groupBy("block", "n", "term").agg(
        F.sum("df").alias("df"), F.sum("tf").alias("tf")
    )
    low = F.when(F.col("block") == WORD_BLOCK, least[0]).otherwise(least[1])
    return stats if max(least) < 2 else stats.filter(F.col("df") >= low)


def _lister(most: int, names: list[str]):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.columns[:-2]
            for at, blocks in _documents(batch, most):
                for block, grams in zip(BLOCKS, blocks, strict=True):
                    found = list(grams.documents())
                    ids = np.concatenate([ids for ids, _ in found])
                    if not len(ids):
                        continue
                    same = pa.array(np.repeat(np.array(at), [len(ids) for ids, _ in found]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(k.take(same) for k in keys),
                            pa.array([block]).take(pa.array(np.zeros(len(ids), np.int32))),
                            pa.array(grams.sizes[ids]),
                            grams.strings(ids),
                            pa.array(np.concatenate([times for _, times in found])),
                        ],
                        names,
                    )

    return rows


def _schema(df: DataFrame, keys: Sequence[str], *added: StructField) -> StructType:
    return StructType([df.schema[k] for k in keys] + list(added))


def term_counts(
    df: DataFrame,
    ngram_max: int = fv.NGRAM_MAX,
    keys: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Term counts per document as rows: ``keys, block, n, term, tf``."""
    schema = _schema(
        df, keys, StructField("block", StringType()), StructField("n", IntegerType()),
        StructField("term", StringType()), StructField("tf", LongType()),
    )
    return _tokenized(df, keys, text_col).mapInArrow(
        _lister(ngram_max, schema.fieldNames()), schema
    )


# --- vocabulary ------------------------------------------------------------------------


def prune_terms(stats: DataFrame, n_docs: int, min_df: int, max_df: float) -> DataFrame:
    """Keep terms found in at least ``min_df`` and at most a ``max_df`` share of documents."""
    high = max_df * n_docs
    if high < min_df:
        raise ValueError("max_df corresponds to fewer documents than min_df")
    return stats.filter(F.col("df").between(F.lit(min_df), F.lit(high)))


def cap_terms(stats: DataFrame, max_features: int) -> DataFrame:
    """The most frequent terms of the corpus; equal counts go by term.

    Terms are counted per frequency, and the frequency at which the cap is reached is looked
    up; only the terms of just that frequency are put in order.
    """
    # as many rows as different frequencies, about the root of the corpus at most
    sizes = stats.groupBy("tf").agg(F.count(F.lit(1)).alias("n"))
    above = F.sum("n").over(Window.orderBy(F.desc("tf"))) - F.col("n")
    cut = (
        sizes.withColumn("above", above)
        .filter((F.col("above") < max_features) & (F.col("above") + F.col("n") > max_features))
        .first()
    )
    if cut is None:
        return stats
    ties = numbered(stats.filter(F.col("tf") == cut["tf"]), [F.col("term")])
    kept = ties.filter(F.col("number") <= max_features - cut["above"]).drop("number")
    return stats.filter(F.col("tf") > cut["tf"]).unionByName(kept)


def smooth_idf(df_col: Column, n_docs: int) -> Column:
    return F.log((F.lit(1.0) + F.lit(n_docs)) / (F.lit(1.0) + df_col)) + F.lit(1.0)


def numbered_terms(terms: DataFrame, n_docs: int) -> DataFrame:
    """Add ``idf`` and ``idx``, the word block first, by term; written, so that Catalyst knows
    its true size."""
    idf = smooth_idf(F.col("df"), n_docs)
    coded = terms.withColumns({"idf": idf, "_code": F.when(F.col("block") == WORD_BLOCK, 0).otherwise(1)})
    both = numbered(coded, [F.col("_code"), F.col("term")], "idx")
    return written(both.withColumn("idx", F.col("idx") - 1).drop("_code"), "vocabulary")


def vocabulary(stats: DataFrame, n_docs: int, cfg: TfidfConfig) -> DataFrame:
    """The frozen vocabulary: ``block, term, df, tf, idf, idx``; only it is ever numbered,
    never the corpus."""
    parts = []
    for block in BLOCKS:
        min_df, max_df, max_features = cfg.limits(block)
        terms = stats.filter(F.col("block") == block)
        if block == WORD_BLOCK:
            terms = terms.filter(F.col("n") <= cfg.ngram_max)
        terms = cap_terms(prune_terms(terms, n_docs, min_df, max_df), max_features)
        parts.append(terms.select("block", "term", "df", "tf"))
    return numbered_terms(parts[0].unionByName(parts[1]), n_docs).select(
        "block", "term", "df", "tf", "idf", "idx"
    )


def fit_vocabulary(df: DataFrame, cfg: TfidfConfig, text_col: str = "text") -> DataFrame:
    """Count, prune, cap and number the terms of a document table."""
    least = [cfg.limits(b)[0] for b in BLOCKS]
    stats = written(term_stats(df, cfg.ngram_max, text_col, least), "stats")
    return vocabulary(stats, df.count(), cfg)


# --- weights ---------------------------------------------------------------------------


@dataclass
class Terms:
    """A vocabulary as a worker looks it up: hashes in order, with number and IDF."""

    hashes: np.ndarray
    idx: np.ndarray
    idf: np.ndarray
    size: int
    # per term the variants that hold it, as bits; None: one variant with all terms
    variants: np.ndarray | None = None


def mapped_terms(vocab: DataFrame, variants: str | None = None) -> Terms:
    """Collect a vocabulary, which its caps bound, as arrays."""
    columns = ["block", "term", "idf", "idx"] + ([variants] if variants else [])
    table = vocab.select(*columns).toArrow()
    word = pc.equal(table.column("block"), WORD_BLOCK).to_numpy(zero_copy_only=False).astype(bool)
    text = table.column("term").combine_chunks().cast(pa.large_string())
    if isinstance(text, pa.ChunkedArray):
        text = pa.concat_arrays(text.chunks) if text.num_chunks else pa.array([], pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1]
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    hashes = np.zeros(len(text), np.uint64)
    for code, own in enumerate((word, ~word)):
        at = np.flatnonzero(own)
        # running sums per slice, so that powers of the base stay few
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            low, high = (ends[part[0]], ends[part[-1] + 1]) if len(part) else (0, 0)
            hashes[part] = run_hashes(
                data[low:high], ends[part] - low, ends[part + 1] - low, code
            )
    order = np.argsort(hashes)
    pick = lambda name, kind: table.column(name).to_numpy().astype(kind)[order]
    return Terms(
        hashes[order], pick("idx", np.int32), pick("idf", np.float64), len(order),
        pick(variants, np.int64) if variants else None,
    )


def _weights(
    grams: Grams, terms: Terms, sublinear: bool
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per document of a run the places in the vocabulary, numbers and raw weights of its known
    terms, by number."""
    at = np.searchsorted(terms.hashes, grams.hashes)
    at[at == terms.size] = 0
    known = terms.hashes[at] == grams.hashes if terms.size else np.zeros(len(at), bool)
    for ids, times in grams.documents():
        own = known[ids]
        place, tf = at[ids[own]], times[own].astype(float)
        number = terms.idx[place]
        order = np.argsort(number)
        place, tf = place[order], tf[order]
        weight = ((1.0 + np.log(tf)) if sublinear else tf) * terms.idf[place]
        yield place, number[order], weight


def _lists(parts: list[np.ndarray], empty: np.ndarray) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) for p in parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([empty, *parts])))


def _packer(shared, cfg: TfidfConfig, names: list[str]):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for batch in batches:
            keys = batch.columns[:-2]
            for at, blocks in _documents(batch, cfg.ngram_max):
                indices, values = [], []
                weighed = [
                    _weights(grams, terms, cfg.sublinear(block))
                    for block, grams in zip(BLOCKS, blocks, strict=True)
                ]
                for document in zip(*weighed, strict=True):
                    numbers, weights = [], []
                    for _, number, weight in document:
                        length = np.sqrt((weight * weight).sum())
                        numbers.append(number)
                        weights.append(weight / length if length else weight)
                    indices.append(np.concatenate(numbers))
                    values.append(np.concatenate(weights))
                same = pa.array(np.array(at))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(k.take(same) for k in keys),
                        _lists(indices, np.zeros(0, np.int32)),
                        _lists(values, np.zeros(0)),
                    ],
                    names,
                )

    return pack


def packed_documents(
    df: DataFrame,
    vocab: DataFrame,
    cfg: TfidfConfig,
    keys: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``keys, indices, values``, both blocks, unit length each, in one
    pass with a frozen vocabulary; unknown terms are ignored. Documents without a known term
    stay, with empty lists."""
    schema = _schema(
        df, keys, StructField("indices", ArrayType(IntegerType())),
        StructField("values", ArrayType(DoubleType())),
    )
    if vocab.count() > MAPPED_TERMS:
        return _packed_by_join(df, vocab, cfg, keys, text_col)
    shared = df.sparkSession.sparkContext.broadcast(mapped_terms(vocab))
    return _tokenized(df, keys, text_col).mapInArrow(
        _packer(shared, cfg, schema.fieldNames()), schema
    )


def _packed_by_join(df, vocab, cfg, keys, text_col) -> DataFrame:
    """The same by joins, for vocabularies too large to send."""
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "documents")
    counts = term_counts(rows, cfg.ngram_max, ["_row"], text_col)
    weighed = tfidf_union(counts, vocab, cfg, ["_row"])
    lists = weighed.groupBy("_row").agg(
        F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("_e")
    )
    return rows.select("_row", *keys).join(lists, "_row", "left").select(
        *keys,
        F.coalesce("_e.idx", F.array().cast("array<int>")).alias("indices"),
        F.coalesce("_e.weight", F.array().cast("array<double>")).alias("values"),
    )


def tfidf_union(
    counts: DataFrame, vocab: DataFrame, cfg: TfidfConfig, keys: Sequence[str] = ("doc_id",)
) -> DataFrame:
    """Weights from given counts, each block of unit length per document:
    ``keys, block, term, idx, weight``. ``keys`` must tell documents apart."""
    tf = F.col("tf").cast("double")
    scaled = tf
    for block in BLOCKS:
        if cfg.sublinear(block):
            scaled = F.when(F.col("block") == block, F.lit(1.0) + F.log(tf)).otherwise(scaled)
    terms = broadcast_if_small(vocab.select("block", "term", "idf", "idx"))
    rows = counts.join(terms, ["block", "term"]).select(
        *keys, "block", "term", "idx", (scaled * F.col("idf")).alias("weight")
    )
    block = Window.partitionBy(*keys, "block")
    length = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(block))
    return rows.withColumn("weight", F.col("weight") / length)


def entries(packed: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Packed documents as rows: ``keys, idx, weight``."""
    pairs = F.arrays_zip("indices", "values")
    return packed.select(*keys, F.explode(pairs).alias("_e")).select(
        *keys, F.col("_e.indices").alias("idx"), F.col("_e.values").alias("weight")
    )


def tfidf_transform(
    df: DataFrame,
    vocab: DataFrame,
    cfg: TfidfConfig,
    keys: Sequence[str] = ("doc_id",),
    text_col: str = "text",
) -> DataFrame:
    """Weigh new text with a frozen vocabulary as rows: ``keys, block, term, idx, weight``."""
    rows = entries(packed_documents(df, vocab, cfg, keys, text_col), keys)
    names = broadcast_if_small(vocab.select("idx", "block", "term"))
    return rows.join(names, "idx").select(*keys, "block", "term", "idx", "weight")
