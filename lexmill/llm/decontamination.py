"""Benchmark decontamination by template windows.

Texts become canonical tokens: numbers, units of measure and names turn into typed
placeholders, other words are lower-cased, punctuation is dropped. A name is a capitalised
word that opens no sentence; the words of a name are one token. A unit belongs to its number,
whose placeholder then is of the unit's kind (length, mass, time, ...): "5 km" stands where "12
miles" stands, but not where "8 kg", "12%", "$5" or a bare number does. Numbers spelled in
English are numbers too. Windows of ``WINDOW``
tokens of the documents are hash-joined to those of the benchmark, so a question with other
numbers or names still meets its source. Matched windows of one alignment of a document and
an item are put together, and with them those of nearby alignments, as words put in or left
out shift the rest; the slots' values must then correspond one to one (equal values of
the item stand where equal values of the document stand), and a share of the item's windows
must be covered.

Documents are cut into windows inside the tasks. Up to ``MOST_KEYS`` benchmark windows go to
the executors as a sorted array that drops windows found nowhere before the join; a larger
benchmark is joined by the shuffle alone, with the same results.

Defined cases: null and empty texts have no windows and match nothing; an item shorter than
``WINDOW`` is one window of its own length, and one of fewer than ``LEAST_TOKENS`` tokens
matches nothing; windows with fewer than half literal words count by their literal words
only, in which all windows are compared as well; a name that opens a window also counts as a
literal word, since the text before it decides whether it opens a sentence; items of equal
text are reported each; repeated documents are reported once per id; documents and items
with a null id are reported with it; empty tables give an empty result; other columns are
not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_words import (
    DIGIT,
    PUNCTUATED,
    UPPER,
    Words,
    inside_rows,
    mix64,
    shingles,
    words_of,
)
from lexmill.session import bounded_batches, written

WINDOW = 8
LEAST_TOKENS = 5
MOST_KEYS = 1 << 21
LEAST_COVER = 0.5

# words after a number, by kind of unit
UNITS = {
    "length": "mm cm m km in ft yd mi meter meters metre metres kilometer kilometers kilometre "
    "kilometres centimeter centimeters mile miles inch inches foot feet yard yards",
    "mass": "mg g kg lb oz t gram grams kilogram kilograms pound pounds ounce ounces",
    "volume": "ml cl l gal liter liters litre litres gallon gallons",
    "time": "s sec min h hr hrs ms day days week weeks month months year years second seconds "
    "minute minutes hour hours",
    "money": "dollar dollars euro euros cent cents usd eur gbp",
    "share": "percent",
    "angle": "degree degrees",
    "speed": "kmh mph",
    "frequency": "hz khz mhz ghz",
    "data": "kb mb gb tb",
    "power": "w kw",
    "energy": "kwh wh j kj cal kcal",
    "voltage": "v volt volts",
    "pressure": "pa kpa bar",
}
# numbers in words; "one" is one only before a unit
SPELLED = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen "
    "sixteen seventeen eighteen nineteen twenty"
).split()
SPELLED_TENS = "thirty forty fifty sixty seventy eighty ninety hundred".split()

_U64 = np.uint64
_NUMBER, _NAME = _U64(11), _U64(13)
_DOT_COMMA = np.zeros(256, bool)
_DOT_COMMA[[44, 46]] = True
_STOPS = np.zeros(256, bool)
_STOPS[[10, 33, 46, 58, 63]] = True
# first bytes of accented capitals in UTF-8 are C3 80 to C3 9E
_C3 = 0xC3


def _inner_points(data: np.ndarray) -> np.ndarray:
    """Points and commas between digits belong to their number."""
    found = _DOT_COMMA[data]
    if len(data):
        digit = DIGIT[data]
        found[1:] &= digit[:-1]
        found[:-1] &= digit[1:]
        found[0] = found[-1] = False
    return found


def _hashes(words: list[str]) -> np.ndarray:
    return next(words_of(pa.array([" ".join(words)]))).hashes


def _looked_up(words: list[str], values) -> tuple[np.ndarray, np.ndarray]:
    hashes = _hashes(words)
    order = np.argsort(hashes)
    return hashes[order], np.asarray(values)[order]


_KINDS = list(UNITS)
_UNIT_HASHES, _UNIT_KINDS = _looked_up(
    [w for words in UNITS.values() for w in words.split()],
    [k + 1 for k, words in enumerate(UNITS.values()) for _ in words.split()],
)
_SPELLED_HASHES, _SPELLED_VALUES = _looked_up(
    SPELLED + SPELLED_TENS, _hashes([str(i) for i in [*range(21), *range(30, 101, 10)]])
)
(_ONE,) = _hashes(["one"])
_SHARE, _MONEY = _KINDS.index("share") + 1, _KINDS.index("money") + 1
# a placeholder per kind; 0 is a bare number
_NUMBERS = mix64(np.arange(len(_KINDS) + 1, dtype=_U64) + _NUMBER)


def _found(values: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which values are known, and their places."""
    place = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[place] == values, place


def _signs(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(kind of the sign at each word, whether the word is a sign and a number): % after it, or a
    sign of money on either side. Signs outside ASCII are part of their word."""
    data = np.concatenate([words.data, np.zeros(4, np.uint8)])
    begin, end = words.begin, words.end
    row = np.searchsorted(words.row_begin, begin, side="right") - 1
    low, high = words.row_begin[row], words.row_begin[row + 1]
    money = ((begin > low) & (data[begin - 1] == ord("$"))) | ((end < high) & (data[end] == ord("$")))
    number = np.zeros(len(begin), bool)
    for code in ("€".encode(), "£".encode()):
        n = len(code)
        long = end - begin > n
        head, tail = long.copy(), long.copy()
        for i, c in enumerate(code):
            head &= data[begin + np.minimum(i, end - begin)] == c
            tail &= data[np.maximum(end - n + i, begin)] == c
        head &= DIGIT[data[np.minimum(begin + n, len(data) - 1)]]
        number |= head
        money |= head | tail
    share = (end < high) & (data[end] == ord("%"))
    return np.where(share, _SHARE, np.where(money, _MONEY, 0)), number


def tokens_of(column) -> Iterator[tuple[Words, np.ndarray, np.ndarray, Words]]:
    """(words, canonical token hashes, whether the token is a placeholder, literal words)."""
    for words in words_of(column, PUNCTUATED, _inner_points):
        tokens = words.hashes.copy()
        if not len(tokens):
            yield words, tokens, np.zeros(0, bool), words
            continue
        data, begin = words.data, words.begin
        spelled, digits = _found(tokens, _SPELLED_HASHES)
        signs, signed = _signs(words)
        number = DIGIT[data[begin]] | signed | spelled
        unit, named = _found(tokens, _UNIT_HASHES)
        # a unit is one only after a number of its text
        unit[1:] &= number[:-1]
        unit[0] = False
        unit[words.first[:-1][words.first[:-1] < len(tokens)]] = False
        kind = np.where(number, signs, 0)
        kind[:-1] = np.where(unit[1:], _UNIT_KINDS[named[1:]], kind[:-1])
        number &= (tokens != _ONE) | (kind > 0)
        unit[1:] &= number[:-1]
        spelled &= number
        second = data[np.minimum(begin + 1, len(data) - 1)]
        capital = UPPER[data[begin]] | ((data[begin] == _C3) & (second >= 0x80) & (second <= 0x9E))
        # words in capitals throughout, and single letters, are no names
        capital &= (words.end - begin > 1) & ~UPPER[second]
        stops = np.concatenate([[0], np.cumsum(_STOPS[data])])
        opens = np.ones(len(tokens), bool)
        opens[1:] = stops[begin[1:]] > stops[words.end[:-1]]
        opens[words.first[:-1][words.first[:-1] < len(tokens)]] = True
        name = capital & ~opens & ~number & ~unit
        tokens[number], tokens[name] = _NUMBERS[kind[number]], _NAME
        # a word of a name that goes on after one space or hyphen, and a unit, are no tokens
        gap = data[words.end[:-1]]
        more = np.zeros(len(tokens), bool)
        more[1:] = name[1:] & name[:-1] & (begin[1:] == words.end[:-1] + 1) & ((gap == 32) | (gap == 45))
        values = words.hashes.copy()
        values[spelled] = _SPELLED_VALUES[digits[spelled]]
        for k in np.flatnonzero(more):  # the value of a name is that of all its words
            values[k] = mix64(values[k - 1 : k] * _U64(3) + values[k : k + 1])[0]
        ends = np.flatnonzero(name & ~np.append(more[1:], False))
        heads = np.flatnonzero(name & ~more)
        values[heads] = values[ends]
        keep = ~more & ~unit
        first = np.concatenate([[0], np.cumsum(keep)])[words.first]
        literal = words
        words = words._replace(first=first, hashes=values[keep], begin=begin[keep], end=words.end[keep])
        yield words, tokens[keep], (number | name)[keep], literal


_TEMPLATE, _LITERAL = 0, 1


def _windows(words, tokens, slot, literal, size: int, strict: bool):
    """(kind, row, place, hashes, slots inside) of the windows of ``size`` tokens: templates
    with enough literal words, those again with a name at their head taken literally, and
    literal words. ``strict``: the second only where the first is used."""
    span = np.arange(size)
    keys = shingles(tokens, size)
    if len(keys):
        filled = np.concatenate([[0], np.cumsum(slot)])
        filled = filled[size:] - filled[:-size]
        whole = inside_rows(words.first, size)
        at = np.flatnonzero(whole & (2 * filled <= size))
        yield _TEMPLATE, words, at, keys[at], slot[at[:, None] + span]
        named = whole & slot[: len(keys)] & (tokens[: len(keys)] == _NAME)
        at = np.flatnonzero(named & (2 * (filled if strict else filled - 1) <= size))
        if len(at):
            parts = tokens[at[:, None] + span]
            parts[:, 0] = words.hashes[at]
            inside = slot[at[:, None] + span]
            inside[:, 0] = False
            # each window as a row of its own
            yield _TEMPLATE, words, at, shingles(parts.ravel(), size)[::size], inside
    keys = shingles(literal.hashes, size)
    if len(keys):
        at = np.flatnonzero(inside_rows(literal.first, size))
        found = mix64(keys[at] + _U64(0x9E3779B97F4A7C15))
        yield _LITERAL, literal, at, found, np.zeros((len(at), size), bool)


_FIELDS = "id long, kind int, size int, place long, key long, slots array<long>"


def _window_rows(texts: DataFrame, sizes, keys=None) -> DataFrame:
    """``id, kind, size, place`` (token number), ``key`` and the values of the window's slots.
    ``sizes``: fixed sizes, or None for ``WINDOW`` or the whole of a shorter text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if keys is None else np.frombuffer(keys.value, _U64)
        for batch in batches:
            ids = batch.column(0)
            for parts in tokens_of(batch.column(1)):
                for size in sizes or range(LEAST_TOKENS, WINDOW + 1):
                    for kind, words, at, found, inside in _windows(*parts, size, sizes is None):
                        row = np.searchsorted(words.first, at, side="right") - 1
                        ok = np.ones(len(at), bool)
                        if sizes is None and size < WINDOW:
                            ok = np.diff(words.first)[row] == size
                        if known is not None:
                            place = np.searchsorted(known, found)
                            ok &= known[np.minimum(place, len(known) - 1)] == found
                        at, found, row, inside = at[ok], found[ok], row[ok], inside[ok]
                        if not len(at):
                            continue
                        values = words.hashes[(at[:, None] + np.arange(size))[inside]].view(np.int64)
                        ends = np.concatenate([[0], np.cumsum(inside.sum(1))]).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [ids.take(pa.array(words.start + row)),
                             pa.array(np.full(len(at), kind, np.int32)),
                             pa.array(np.full(len(at), size, np.int32)),
                             pa.array(at - words.first[row]),
                             pa.array(found.view(np.int64)),
                             pa.ListArray.from_arrays(pa.array(ends), pa.array(values))],
                            ["id", "kind", "size", "place", "key", "slots"],
                        )

    return texts.mapInArrow(run, _FIELDS)


def best_union(alignments: list[dict]) -> int:
    """Most windows of an item that alignments of nearby shifts hold together, with values of
    slots that correspond one to one."""

    def added(there: dict, back: dict, slots: list[dict]) -> tuple[dict, dict] | None:
        there, back = dict(there), dict(back)
        for slot in slots:
            x, y = slot["x"], slot["y"]
            if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
                return None
        return there, back

    ready = [(a["shift"], set(a["places"]), a["slots"]) for a in alignments]
    ready = sorted((a for a in ready if added({}, {}, a[2])), key=lambda a: a[0])
    every = set().union(*(a[1] for a in ready)) if ready else set()
    # as far as an item is long
    reach = max(every, default=0) - min(every, default=0) + WINDOW
    shifts = [a[0] for a in ready]
    best = 0
    for anchor in sorted(ready, key=lambda a: -len(a[1])):
        low, high = bisect_left(shifts, anchor[0] - reach), bisect_right(shifts, anchor[0] + reach)
        known, places = added({}, {}, anchor[2]), set(anchor[1])
        for other in sorted(ready[low:high], key=lambda a: (abs(a[0] - anchor[0]), a[0])):
            if other[1] <= places:
                continue
            more = added(*known, other[2])
            if more:
                known = more
                places |= other[1]
        best = max(best, len(places))
        if best == len(every):
            break
    return best


def _best_unions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        windows = [best_union(row.as_py()) for row in batch.column(3)]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:3], pa.array(windows, pa.int64())],
            ["doc_id", "item_id", "kind", "windows"],
        )


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text: str = "text",
    least_cover: float = LEAST_COVER,
    most_keys: int = MOST_KEYS,
) -> DataFrame:
    """``doc_id, item_id, windows`` (of the item, matched), ``cover``, one row per pair of a
    document and an item that it holds."""
    spark = docs.sparkSession
    bounded_batches(spark)
    one = lambda df, c: df.select(F.col(c).cast("long").alias("id"), F.col(text).alias("text"))
    items = written(_window_rows(one(benchmark, item_id), None), "items")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # 5 to WINDOW
    distinct = items.select("key").distinct()
    keys = None
    if distinct.limit(most_keys + 1).count() <= most_keys:
        found = np.sort(distinct.toArrow().column(0).to_numpy().view(_U64))
        keys = spark.sparkContext.broadcast(found.tobytes())  # 8 bytes each
    if not sizes:
        return spark.createDataFrame([], "doc_id long, item_id long, windows long, cover double")
    totals = items.groupBy("id", F.col("kind").alias("of")).agg(F.countDistinct("place").alias("total"))
    theirs = items.select(
        "key", "kind", F.col("id").alias("item_id"), F.col("place").alias("item_place"),
        F.col("slots").alias("item_slots"),
    )
    mine = _window_rows(one(docs, doc_id), sizes, keys).withColumnRenamed("id", "doc_id")
    mine = mine.drop("kind")
    pairs = F.transform(
        F.sequence(F.lit(1), F.size("slots")),
        lambda i: F.struct(
            F.element_at("item_slots", i).alias("x"), F.element_at("slots", i).alias("y")
        ),
    )
    joined = mine.join(theirs, "key").select(
        "doc_id", "item_id", "kind", "item_place", (F.col("place") - F.col("item_place")).alias("shift"),
        F.when(F.size("slots") > 0, pairs).otherwise(F.array().cast("array<struct<x:long,y:long>>"))
        .alias("slots"),
    )
    # an alignment has at most the windows of its item
    aligned = joined.groupBy("doc_id", "item_id", "kind", "shift").agg(
        F.collect_set("item_place").alias("places"),
        F.array_distinct(F.flatten(F.collect_set("slots"))).alias("slots"),
    )
    # as many alignments as the document has tokens at most
    pairs = aligned.groupBy("doc_id", "item_id", "kind").agg(
        F.collect_list(F.struct("shift", "places", "slots")).alias("alignments")
    )
    best = pairs.mapInArrow(_best_unions, "doc_id long, item_id long, kind int, windows long")
    best = best.filter("windows > 0")
    same = best["item_id"].eqNullSafe(totals["id"]) & (best["kind"] == totals["of"])
    measured = best.join(totals, same).withColumn("cover", F.col("windows") / F.col("total"))
    # the better of templates and literal words
    return (
        measured.filter(F.col("cover") >= least_cover)
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.struct("cover", "windows")).alias("best"))
        .select("doc_id", "item_id", "best.windows", "best.cover")
    )


def without_leaks(docs: DataFrame, leaks: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The documents that hold no benchmark item; those without id stay if no leak has none."""
    held = written(leaks.select(F.col("doc_id").alias("_held")).distinct(), "held")
    return docs.join(held, docs[doc_id].eqNullSafe(F.col("_held")), "left_anti")
