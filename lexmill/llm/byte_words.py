"""Words, their hashes and word shingles of whole Arrow text columns, by array arithmetic.

Used inside ``mapInArrow`` tasks. Texts are read straight from the Arrow buffers in slices
of about a megabyte, so memory follows the longest single text and not the batch. A word's
hash is a polynomial over its bytes modulo 2**64, finished by an avalanche step; a shingle's
hash is built from its words' hashes in the same way. Two different shingles share a hash
with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_BYTES = np.arange(256)
SPACE = (_BYTES == 32) | ((_BYTES >= 9) & (_BYTES <= 13))
UPPER = (_BYTES >= 65) & (_BYTES <= 90)
LOWER = np.where(UPPER, _BYTES + 32, _BYTES).astype(np.uint8)
DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
LETTER = UPPER | ((_BYTES >= 97) & (_BYTES <= 122)) | (_BYTES >= 128)
# everything but letters and digits parts words
PUNCTUATED = ~(DIGIT | LETTER)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_TABLE = np.random.Generator(np.random.PCG64(2024)).integers(1, 2**63, 256, dtype=np.uint64)
_CODE = _TABLE[LOWER] * np.uint64(2) + np.uint64(1)


def mix64(h: np.ndarray) -> np.ndarray:
    """Avalanche step on unsigned 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, grown when a text needs more."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            inverse = np.uint64(pow(int(_BASE), -1, 2**64))
            self.up, self.down = (
                np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
                for b in (_BASE, inverse)
            )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


class Words(NamedTuple):
    """Words of consecutive rows: ``first[i]:first[i + 1]`` are the words of row ``start + i``."""

    start: int  # number of the first row in the batch
    first: np.ndarray  # rows + 1
    hashes: np.ndarray  # uint64 per word, A-Z lower-cased
    begin: np.ndarray  # byte positions in ``data``
    end: np.ndarray
    data: np.ndarray  # the rows' bytes
    row_begin: np.ndarray  # byte position of each row, rows + 1

    @property
    def rows(self) -> int:
        return len(self.first) - 1


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a text column and each row's offsets; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset :][: len(column) + 1]
    body = column.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    if not len(column):
        return data[:0], np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row offsets) of runs of rows with about ``most`` bytes."""
    data, offsets = text_bytes(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + most, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def words_of(column, apart: np.ndarray = SPACE, joined=None) -> Iterator[Words]:
    """Words of a text column. ``apart`` marks the bytes between words; ``joined(data)`` may
    return positions that belong to words all the same."""
    for start, data, offsets in slices(column):
        n = len(data)
        inside = ~apart[data]
        if joined is not None:
            inside |= joined(data)
        row_start = np.zeros(n + 1, bool)
        row_start[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:] = inside[:-1] & ~row_start[1:n]
            after[:-1] = inside[1:] & ~row_start[1:n]
        begin = np.flatnonzero(inside & ~before)
        end = np.flatnonzero(inside & ~after) + 1
        up, down = _POWERS.upto(max(n, 1))
        sums = np.empty(n + 1, np.uint64)
        sums[0] = 0
        np.cumsum(_CODE[data] * up, out=sums[1:])
        hashes = mix64((sums[end] - sums[begin]) * down[begin] if len(begin) else sums[:0])
        first = np.searchsorted(begin, offsets)
        yield Words(start, first, hashes, begin, end, data, offsets)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` words from each position; the last positions have too few words
    and are left out. Rows are not looked at: see ``inside_rows``."""
    n = len(hashes) - size + 1
    if n <= 0:
        return hashes[:0]
    total = np.zeros(n, np.uint64)
    for k in range(size):
        total = total * _BASE + hashes[k : k + n]
    return mix64(total + np.uint64(size))


def inside_rows(first: np.ndarray, size: int) -> np.ndarray:
    """For each position of ``shingles``: whether all its words are of one row."""
    n = int(first[-1]) - size + 1
    ok = np.ones(max(n, 0), bool)
    for cut in first[1:-1]:
        ok[max(cut - size + 1, 0) : cut] = False
    return ok


def row_shingles(words: Words, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes); fewer words than ``size`` make one shingle."""
    every = shingles(words.hashes, size)
    for i in range(words.rows):
        a, b = int(words.first[i]), int(words.first[i + 1])
        if b - a >= size:
            found = every[a : b - size + 1]
        elif b > a:
            found = shingles(words.hashes[a:b], b - a)
        else:
            found = every[:0]
        yield words.start + i, np.unique(found)


def set_key(hashes: np.ndarray) -> np.uint64:
    """Key of a set of hashes, the same for equal sets."""
    with np.errstate(over="ignore"):
        spread = mix64(hashes + np.uint64(0x632BE59BD9B4E019))
        return mix64(np.array([spread.sum(dtype=np.uint64) + np.uint64(len(hashes))]))[0]
