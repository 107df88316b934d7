"""Word and character n-grams of whole Arrow columns, counted where the document lies.

Used inside ``mapInArrow`` tasks, on tokens and words that Spark has cut out of the lower-case
text. A run of documents is worked on at once: its distinct words are numbered, character n-grams
are cut and hashed once per distinct word, and word n-grams are told apart by the numbers of their
words. A document is then a list of term numbers, which are counted without sorting them. Terms are
byte runs hashed to 64 bits as polynomials, by differences of running sums. Two n-grams share a hash
with probability near 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

from lexmill import fixed_values as fv

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_CODE = np.random.Generator(np.random.PCG64(11)).integers(1, 2**63, 256, dtype=np.uint64)
_CODE = _CODE * np.uint64(2) + np.uint64(1)
# added to the hashes of a block, so that equal letters in both blocks are two terms
_SALT = (np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25))
_SPACE = 32
# Bytes of words hashed at once.
_HASHED_BYTES = 1 << 16


class _Powers:
    """Powers of the odd base and of its inverse modulo 2**64, grown when a text needs more."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            one = np.ones(1, np.uint64)
            self.up, self.down = (
                np.concatenate([one, np.cumprod(np.full(size - 1, b, np.uint64))])
                for b in (_BASE, _INVERSE)
            )
        return self.up[:n], self.down[:n]


_POWERS = _Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _run_values(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Byte runs as polynomials in the base."""
    up, down = _POWERS.upto(max(len(data), 1))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODE[data] * up[: len(data)])])
    return (sums[end] - sums[begin]) * down[begin]


def _hashed(values: np.ndarray, block: int) -> np.ndarray:
    return _mixed(values + _SALT[block])


def run_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray, block: int) -> np.ndarray:
    """Hashes of the byte runs ``data[begin:end]`` as terms of a block."""
    return _hashed(_run_values(data, begin, end), block)


class Words(NamedTuple):
    """The words of a run of rows, as numbers of its distinct words."""

    codes: np.ndarray  # of each word
    rows: np.ndarray  # first word of each row, one more than there are rows
    distinct: pa.Array
    data: np.ndarray  # bytes of the distinct words
    ends: np.ndarray  # byte positions, one more than there are distinct words

    @staticmethod
    def of(column: pa.ListArray, at: range) -> Words:
        offsets = column.offsets.to_numpy()[at.start : at.stop + 1].astype(np.int64)
        first = int(offsets[0])
        coded = column.values.slice(first, int(offsets[-1]) - first).dictionary_encode()
        data, ends = _bytes_of(coded.dictionary)
        return Words(
            coded.indices.to_numpy().astype(np.int64), offsets - first, coded.dictionary, data, ends
        )

    def slices(self) -> Iterator[tuple[int, int]]:
        """Distinct words cut into runs of about ``_HASHED_BYTES`` bytes."""
        a, last = 0, len(self.ends) - 1
        while a < last:
            b = int(np.searchsorted(self.ends, self.ends[a] + _HASHED_BYTES, side="right")) - 1
            b = min(max(b, a + 1), last)
            yield a, b
            a = b


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and byte positions of a string column."""
    text = column.cast(pa.large_string())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1]
    body = text.buffers()[2]
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return data, ends if len(ends) else np.zeros(1, np.int64)


def _counted(
    ids: np.ndarray, place: np.ndarray, times: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and how often they occur; ``place`` is room for one cell per number."""
    order = np.arange(len(ids), dtype=place.dtype)
    place[ids] = order
    at = place[ids]  # the same place for equal numbers
    first = np.flatnonzero(at == order)
    return ids[first], np.bincount(at, times, len(ids))[first].astype(np.int64)


def _numbers(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number per key, equal for equal keys, and the place of a key of each number."""
    codes, distinct = pd.factorize(keys)
    first = np.zeros(len(distinct), np.int64)
    first[codes] = np.arange(len(codes))
    return codes, first


class WordGrams:
    """Word n-grams of a run of documents; terms have numbers."""

    def __init__(self, words: Words, most: int) -> None:
        self.words = words
        count = len(words.ends) - 1
        values = np.zeros(count, np.uint64)
        for a, b in words.slices():
            low, high = words.ends[a], words.ends[b]
            values[a:b] = _run_values(
                words.data[low:high], words.ends[a:b] - low, words.ends[a + 1 : b + 1] - low
            )
        size = np.diff(words.ends)
        # per n: number by position, and by number the first position
        self.at: list[np.ndarray] = []
        hashes, sizes, firsts = [], [], []
        number, width, known, length = words.codes, 0, values, size
        longest = int(np.diff(words.rows).max(initial=0))
        for n in range(1, min(most, longest) + 1):
            if n == 1:
                first = np.zeros(count, np.int64)
                first[number] = np.arange(len(number))
                ids = number
            else:
                # no n-gram reaches into the next document
                left = np.repeat(words.rows[1:], np.diff(words.rows)) - np.arange(len(words.codes))
                whole = np.flatnonzero(left >= n)
                last = words.codes[whole + n - 1]
                pairs = number[whole] * count + last
                inverse, first = _numbers(pairs)
                before, after = number[whole][first], last[first]
                up, _ = _POWERS.upto(int(length[before].max(initial=0)) + 2)
                known = known[before] + up[length[before]] * (
                    _CODE[_SPACE] + np.uint64(_BASE) * values[after]
                )
                length = length[before] + 1 + size[after]
                ids = np.zeros(len(words.codes), np.int64)
                ids[whole] = inverse
                first = whole[first]
                number = ids
            self.at.append(ids + width)
            hashes.append(known)
            sizes.append(np.full(len(known), n, np.int32))
            firsts.append(first)
            width += len(known)
        self.hashes = _hashed(np.concatenate([np.zeros(0, np.uint64), *hashes]), 0)
        self.sizes = np.concatenate([np.zeros(0, np.int32), *sizes])
        self._first = np.concatenate([np.zeros(0, np.int64), *firsts])

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per document the numbers of its terms and their counts."""
        place = np.zeros(len(self.hashes), np.int64)
        none = np.zeros(0, np.int64)
        for a, b in zip(self.words.rows, self.words.rows[1:], strict=False):
            parts = [ids[a : max(a, b - n)] for n, ids in enumerate(self.at)]
            yield _counted(np.concatenate([none, *parts]), place)

    def strings(self, ids: np.ndarray) -> pa.Array:
        order, parts = [], []
        for n in range(1, len(self.at) + 1):
            own = np.flatnonzero(self.sizes[ids] == n)
            first = self._first[ids[own]]
            pieces = [
                self.words.distinct.take(pa.array(self.words.codes[first + i])) for i in range(n)
            ]
            order.append(own)
            parts.append(pc.binary_join_element_wise(*pieces, " ") if n > 1 else pieces[0])
        if not parts:
            return pa.array([], pa.string())
        return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(order))))


class CharGrams:
    """N-grams inside space-padded words; they hold no space but at their ends."""

    def __init__(self, words: Words) -> None:
        self.words = words
        low, high = fv.CHAR_NGRAM_RANGE
        none = np.zeros(0, np.int64)
        sizes, begins, ends = ([np.zeros(0, np.int32)] for _ in range(3))
        hashes, layouts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)], [none]
        base = 0
        for a, b in words.slices():
            data = _padded(words.data, words.ends[a : b + 1])
            at = np.flatnonzero((data & 0xC0) != 0x80)
            spaces = np.cumsum(data[at] == _SPACE)
            stop = np.append(at, len(data))
            runs = []
            for n in range(low, min(high, len(at)) + 1):
                first = np.arange(len(at) - n + 1)
                inside = first[spaces[first + n - 2] == spaces[first]]
                per = np.bincount(spaces[inside] - 1, minlength=b - a)
                runs.append((n, per, at[inside], stop[inside + n]))
            # by word, a word's shorter n-grams first
            own = sum(per for _, per, _, _ in runs)
            begin, end, size = np.zeros((3, own.sum()), np.int32)
            free = np.cumsum(own) - own
            for n, per, first, last in runs:
                slot = np.arange(len(first)) + np.repeat(free - np.cumsum(per) + per, per)
                begin[slot], end[slot], size[slot] = first, last, n
                free = free + per
            hashes.append(_hashed(_run_values(data, begin, end), 1))
            counts.append(own)
            sizes.append(size)
            begins.append(begin + np.int32(base))
            ends.append(end + np.int32(base))
            layouts.append(data)
            base += len(data)
        hashes = np.concatenate(hashes)
        self._ids, first = _numbers(hashes)
        self.hashes = hashes[first]
        self._upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
        self.sizes = np.concatenate(sizes)[first]
        self._begin, self._end = (np.concatenate(x)[first].astype(np.int64) for x in (begins, ends))
        self._data = np.concatenate(layouts)

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Per document the numbers of its terms and their counts."""
        word_place = np.zeros(len(self._upto) - 1, np.int64)
        place = np.zeros(len(self.hashes), np.int64)
        for a, b in zip(self.words.rows, self.words.rows[1:], strict=False):
            own, times = _counted(self.words.codes[a:b], word_place)
            begin = self._upto[own]
            length = self._upto[own + 1] - begin
            upto = np.cumsum(length)
            total = int(upto[-1]) if len(upto) else 0
            at = np.arange(total) + np.repeat(begin - upto + length, length)
            yield _counted(self._ids[at], place, np.repeat(times, length))

    def strings(self, ids: np.ndarray) -> pa.Array:
        return cut_strings(self._data, self._begin[ids], self._end[ids])


def _padded(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Words with a space before, between and after."""
    sizes = np.diff(ends)
    out = np.full(int(ends[-1] - ends[0]) + len(sizes) + 1, _SPACE, np.uint8)
    at = np.arange(int(sizes.sum())) + np.repeat(np.arange(1, len(sizes) + 1), sizes)
    out[at] = data[ends[0] : ends[-1]]
    return out


Grams = WordGrams | CharGrams


def run_grams(
    words: pa.ListArray, pieces: pa.ListArray, rows: range, most: int
) -> tuple[WordGrams, CharGrams]:
    """The word and the character block of a run of documents."""
    return WordGrams(Words.of(words, rows), most), CharGrams(Words.of(pieces, rows))


def cut_strings(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    """The byte runs as an Arrow string column."""
    sizes = end - begin
    upto = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(upto[-1]) + np.repeat(begin - upto[:-1], sizes)
    body = pa.py_buffer(data[at])
    return pa.Array.from_buffers(
        pa.large_string(), len(begin), [None, pa.py_buffer(upto.astype(np.int64)), body]
    ).cast(pa.string())


def runs_of_rows(words: pa.ListArray, most: int) -> Iterator[range]:
    """Runs of rows of about ``most`` bytes of words."""
    if not len(words):
        return
    flat, offsets = words.values, words.offsets.to_numpy().astype(np.int64)
    kind = np.int64 if pa.types.is_large_string(flat.type) else np.int32
    ends = np.zeros(1, kind)
    if len(flat):
        ends = np.frombuffer(flat.buffers()[1], kind)[flat.offset :]
    upto = ends[offsets]
    row, count = 0, len(words)
    while row < count:
        end = int(np.searchsorted(upto, upto[row] + most, side="right")) - 1
        end = min(max(end, row + 1), count)
        yield range(row, end)
        row = end
