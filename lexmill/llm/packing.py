"""Packing tokenised documents into sequences, by vector best fit.

``token_pieces`` turns each text into the tokens of a public tokenizer and an end token, and cuts
what is longer than a sequence. Words between ASCII white space are tokenised once each: the
tokenizer drops white space and no token crosses it, so a text's tokens are those of its words in
a row. Words are told apart by a 64-bit hash, in a bounded table that a Python worker keeps from
text to text; a text that spells out a special token goes through the tokenizer whole.

``pack_pieces`` deals pieces into groups of about ``group`` by a hash of their row, so no task sees
more, whatever one source or size of document holds. In a group, pieces go from the largest to the
smallest. Each has three sizes, tokens, one document and attention cost (length squared), each
open sequence three residual capacities, and only sequences with room in all three are considered.
Among them the piece goes to the one with the smallest weighted norm of what would be left, or, by
the other rule, with the largest weighted dot product of sizes and residuals; each group is packed
by every rule of ``RULES`` and keeps the one with fewest sequences. A new sequence is opened only
if none has room. Sequences that are not ``FULL`` after a round are opened again and their pieces
dealt into fewer groups, until one group holds them all: what is left over is less than a group's
last sequences, not one per group.

Defined cases: a null or empty text has just the end token; equal pieces go by row; repeated rows
and ids are packed each for itself; an empty table gives no rows. Columns other than those added
are carried along; those of the added names are replaced. A length outside 1 to the capacity, or a
piece whose cost alone exceeds the attention capacity, is an error.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator, Sequence
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from lexmill.llm.byte_words import text_bytes, words_of
from lexmill.session import bounded_batches, spread, written

CAPACITY = 2048
END = 0
# Pieces packed together in one task.
GROUP = 8192
# A sequence this full is not opened again.
FULL = 0.998
# Words whose tokens a worker remembers (about 40 bytes each).
KNOWN_WORDS = 1 << 20
# Pieces in an Arrow batch that goes back to Spark (64 MB of tokens at most).
_BATCH = 8192
# (rule, weights of tokens, documents and attention cost)
RULES = (("norm", (1.0, 0.0, 0.0)), ("norm", (1.0, 0.01, 0.1)), ("dot", (1.0, 0.1, 0.1)))


class Limits(NamedTuple):
    """Capacities of a sequence. Unless given, a sequence may hold as many documents, and
    attend over as many pairs of tokens, as its tokens allow."""

    tokens: int = CAPACITY
    documents: int | None = None
    attention: int | None = None

    def vector(self) -> np.ndarray:
        documents = self.tokens if self.documents is None else self.documents
        attention = self.tokens**2 if self.attention is None else self.attention
        return np.array([self.tokens, documents, attention], np.int64)


# --- tokens ------------------------------------------------------------------------


class KnownWords:
    """Tokens of words by their hash, as arrays; emptied when it has grown too large."""

    def __init__(self, path: str, most: int = KNOWN_WORDS) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int64)
        self.first = np.zeros(1, np.int64)
        self.pool = np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [
            e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ]

    def entries(self, hashes: np.ndarray, spell) -> np.ndarray:
        """Entry of each of the distinct hashes; ``spell(i)`` gives the text of hash i."""
        if len(self.keys) + len(hashes) > self.most:
            self._clear()
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        new = np.flatnonzero(~known)
        if len(new):
            ids = self.encode([spell(i) for i in new])
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((x for word in ids for x in word), np.uint32, int(sizes.sum()))
            made = np.arange(len(new)) + len(self.first) - 1
            self.pool = np.concatenate([self.pool, flat])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
            # both sides are sorted
            self.keys = np.insert(self.keys, at[new], hashes[new])
            self.entry = np.insert(self.entry, at[new], made)
            at = np.searchsorted(self.keys, hashes)
        return self.entry[at]


@lru_cache(maxsize=2)
def known_words(path: str) -> KnownWords:
    return KnownWords(path)


def _ragged(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Positions first[0], first[0] + 1, ... of ``sizes[0]``, then of the next, and so on."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - sizes), sizes)


def _spelled_out(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Rows that may hold a special token's text (``<|``)."""
    at = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    return set((np.searchsorted(offsets, at, side="right") - 1).tolist())


def token_stream(column, known: KnownWords, end: int = END) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, tokens, row offsets) of runs of rows, the end token behind each row."""
    for words in words_of(column):
        distinct, example, entry = np.unique(
            words.hashes, return_index=True, return_inverse=True
        )

        def spell(i, words=words, example=example):
            k = example[i]
            return words.data[words.begin[k] : words.end[k]].tobytes().decode()

        entry = known.entries(distinct, spell)[entry]
        sizes = known.first[entry + 1] - known.first[entry]
        tokens = known.pool[_ragged(known.first[entry], sizes)]
        upto = np.concatenate([[0], np.cumsum(sizes)])[words.first]
        whole = _spelled_out(words.data, words.row_begin)
        if whole:
            rows = [tokens[upto[i] : upto[i + 1]] for i in range(words.rows)]
            for i in whole:
                text = words.data[words.row_begin[i] : words.row_begin[i + 1]].tobytes().decode()
                rows[i] = np.array(known.encode([text])[0], np.uint32)
            tokens = np.concatenate(rows)
            upto = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        tokens = np.insert(tokens, upto[1:], np.uint32(end))
        yield words.start, tokens, upto + np.arange(len(upto))


def _cutter(path: str, text_at: int, capacity: int, end: int, names: list[str]):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = known_words(path)
        for batch in batches:
            columns = list(batch.columns)
            text = columns.pop(text_at)
            for start, tokens, offsets in token_stream(text, known, end):
                lengths = np.diff(offsets)
                pieces = -(-lengths // capacity)
                row = np.repeat(np.arange(len(lengths)), pieces)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                begin = piece * capacity
                length = np.minimum(lengths[row] - begin, capacity)
                at = np.concatenate([[0], np.cumsum(length)])
                for a in range(0, len(row), _BATCH):
                    b = min(a + _BATCH, len(row))
                    part = tokens[at[a] : at[b]].astype("<u4")
                    where = ((at[a : b + 1] - at[a]) * 4).astype(np.int32)
                    ids = pa.Array.from_buffers(
                        pa.binary(), b - a, [None, pa.py_buffer(where), pa.py_buffer(part)]
                    )
                    take = pa.array(start + row[a:b])
                    yield pa.RecordBatch.from_arrays(
                        [
                            *(c.take(take) for c in columns),
                            pa.array(piece[a:b].astype(np.int32)),
                            pa.array(begin[a:b].astype(np.int64)),
                            pa.array(length[a:b].astype(np.int64)),
                            ids,
                        ],
                        names,
                    )

    return cut


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    capacity: int = CAPACITY,
    end: int = END,
) -> DataFrame:
    """``keep, piece, start, length, ids``: a row per piece of at most ``capacity`` tokens.

    ``tokenizer`` is the path of a tokenizer file that every worker can open; ``ids`` holds
    little-endian unsigned 32-bit tokens, the last of a document is ``end``.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(*keep, text_col)
    added = [
        StructField("piece", IntegerType()),
        StructField("start", LongType()),
        StructField("length", LongType()),
        StructField("ids", BinaryType()),
    ]
    schema = StructType([rows.schema[c] for c in keep] + added)
    names = schema.fieldNames()
    return spread(rows, keep[0]).mapInArrow(
        _cutter(tokenizer, len(keep), capacity, end, names), schema
    )


# --- packing -----------------------------------------------------------------------


def best_fit(lengths: np.ndarray, limits: np.ndarray, rule: str, weights) -> np.ndarray:
    """Sequence of each piece; ``lengths`` go from the largest to the smallest."""
    capacity = limits.astype(float)
    weight = np.asarray(weights) / capacity**2
    used = [k for k in range(3) if weights[k]]
    # residual capacities of open sequences, one row per dimension
    left = np.zeros((3, 1024), np.int64)
    name = np.zeros(1024, np.int64)
    n = made = 0
    result = np.empty(len(lengths), np.int64)
    least = int(lengths[-1]) if len(lengths) else 0
    for i, length in enumerate(lengths.tolist()):
        size = (length, 1, length * length)
        room = left[0, :n] >= length
        if limits[1] < limits[0]:
            room &= left[1, :n] >= 1
        if limits[2] < limits[0] ** 2:
            room &= left[2, :n] >= size[2]
        fits = np.flatnonzero(room)
        if len(fits):
            score = np.zeros(len(fits))
            for k in used:
                if rule == "norm":
                    score += weight[k] * (left[k, fits] - size[k]).astype(float) ** 2
                else:
                    score -= weight[k] * size[k] * left[k, fits]
            at = int(fits[score.argmin()])
        else:
            if n == left.shape[1]:
                left = np.concatenate([left, np.zeros_like(left)], axis=1)
                name = np.concatenate([name, np.zeros_like(name)])
            left[:, n], name[n] = limits, made
            at, n, made = n, n + 1, made + 1
        result[i] = name[at]
        left[:, at] -= size
        if left[0, at] < least or left[1, at] < 1 or left[2, at] < least * least:
            # no piece can follow: the last sequence takes its place
            n -= 1
            left[:, at], name[at] = left[:, n], name[n]
    return result


def pack_group(lengths: np.ndarray, limits: Limits = Limits()) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece, by the rule that needs fewest sequences."""
    most = limits.vector()
    if len(lengths) and (
        lengths.min() < 1 or lengths.max() > most[0] or lengths.max() ** 2 > most[2]
    ):
        raise ValueError("a piece does not fit into an empty sequence")
    order = np.argsort(-lengths, kind="stable")
    tried = [best_fit(lengths[order], most, rule, weights) for rule, weights in RULES]
    best = min(tried, key=lambda found: int(found.max(initial=-1)))
    sequence = np.empty(len(lengths), np.int64)
    sequence[order] = best
    offset = np.empty(len(lengths), np.int64)
    # in the order of placement
    by = order[np.argsort(best, kind="stable")]
    sizes = lengths[by]
    upto = np.cumsum(sizes) - sizes
    starts = np.flatnonzero(np.diff(sequence[by], prepend=-1))
    offset[by] = upto - np.repeat(upto[starts], np.diff(np.append(starts, len(by))))
    return sequence, offset


def _packer(length_col: str, limits: Limits, turn: int, full: float):
    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("_row").to_numpy(), kind="stable")
        table = table.drop_columns(["_group"]).take(pa.array(order))
        lengths = table.column(length_col).to_numpy().astype(np.int64)
        sequence, offset = pack_group(lengths, limits)
        filled = np.bincount(sequence, weights=lengths)[sequence]
        number = (turn << 56) + (key[0].as_py() << 24) + sequence
        for name, values in (
            ("sequence_id", number),
            ("offset", offset),
            ("_loose", filled < full * limits.tokens),
        ):
            table = table.set_column(table.schema.get_field_index(name), name, pa.array(values))
        return table

    return pack


def pack_pieces(
    pieces: DataFrame,
    limits: Limits = Limits(),
    length_col: str = "length",
    group: int = GROUP,
    full: float = FULL,
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table of pieces."""
    names = [c for c in pieces.columns if c not in ("sequence_id", "offset", "_row", "_loose")]
    loose = written(
        pieces.select(*names).withColumns(
            {
                "sequence_id": F.lit(0).cast("long"),
                "offset": F.lit(0).cast("long"),
                "_row": F.monotonically_increasing_id(),
                "_loose": F.lit(True),
            }
        ),
        "pieces",
    )
    done = None
    count = loose.count()
    for turn in range(count.bit_length() + 1):
        groups = max(1, math.ceil(count / group))
        packed = written(
            loose.withColumn("_group", F.pmod(F.xxhash64("_row"), F.lit(groups)))
            .groupBy("_group")
            .applyInArrow(_packer(length_col, limits, turn, full), loose.schema),
            "packed",
        )
        if groups == 1:
            return _union(done, packed).select(*names, "sequence_id", "offset")
        done = _union(done, packed.filter(~F.col("_loose")))
        loose = packed.filter("_loose")
        before, count = count, loose.count()
        if 2 * count > before:
            break  # most stay loose: large pieces that nothing fits beside
    return _union(done, loose).select(*names, "sequence_id", "offset")


def _union(done: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if done is None else done.unionByName(more)


def packed_sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id, pieces, length, ids``: the tokens of each sequence in a row."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    joined = F.aggregate(
        "_p", F.lit(b""), lambda all_, p: F.concat(all_, p["ids"])
    )
    return (
        packed.groupBy("sequence_id")
        .agg(ordered.alias("_p"))
        .select(
            "sequence_id",
            F.size("_p").alias("pieces"),
            F.aggregate("_p", F.lit(0).cast("long"), lambda n, p: n + p["length"]).alias("length"),
            joined.alias("ids"),
        )
    )
