"""Exact Jaccard self-join of documents on word shingles, by token-combination prefixes.

Shingles are ordered from rare to frequent. Two sets whose Jaccard similarity is at least
``t`` miss at most ``d = floor((1 - t) * n)`` of either set's ``n`` shingles. A set's prefix
is the shortest start of its order whose signatures can't all be lost with ``d`` shingles:

* a rare shingle (class 1) is a signature itself, lost with one shingle;
* frequent shingles are indexed by pairs (class 2) or triples (class 3) of shingles that
  share a cell; a cell with m shingles in the prefix loses all its pairs with m - 1 of them
  and all its triples with m - 2, so each cell lengthens the prefix by one or two.

Sets of similar size can lack fewer shingles than ``d``, so that combinations are made four
times, each with the prefix that its pairs need: for sets of equal size, for sizes within
about a hundredth, within a few hundredths, and for all others. A combination carries the size, size cell or octave it
was made for; a set that may link into the next cell or octave is indexed under both. The
number of cells follows that size, which keeps the combinations in proportion to the prefix.

Of two linked sets the one whose prefix ends first keeps a signature that the other has too,
whatever the order and the classes, as long as both use the same.

Steps, all but the last on distinct sets (``node``, a 64-bit key of the set):

1. one pass counts every shingle's documents (40-bit keys, counted in numpy blocks) and gives
   each document its node; the ``MOST_LEVELS`` most frequent shingles get levels by their
   count in a hashed table of fixed size, which goes to the executors;
2. one pass writes each set's signatures as one binary value. Most are of one set only: their
   short keys are sorted, keys that occur again are marked in a bit array of fixed size, and only marked signatures become rows (a clash keeps more, never less). A signature's
   smallest node is its pivot. Node keys start with the share of frequent shingles, so that
   the pivot is the least changed copy;
3. each set is verified against its least pivot only; of its other pivots those that are in
   another component then are tried, so that a group of near copies costs an edge per set;
4. sets of a signature that aren't connected yet are compared pair by pair if they are few.
   Many are near copies of one text: around a centre, those that may link share one of the
   few shingles in which each differs from it, and are joined by that. Sets far from the
   centre get another, and those far from all are compared pair by pair. Bounds from
   sizes and from counts of 256 hash cells come first; they never rule out a link;
5. links are verified on whole sets; components are joined back to the documents. Tables are
   deleted when nothing reads them any more.

Nothing is capped or sampled: a wrong class or level costs time, never a link. Keys of 64 bits
stand for sets and shingles; at 10**10 documents a clash of two sets is expected about twice.

Defined cases: a null or empty text, or one of white space, has an empty set, no link and is
its own component; a text with fewer words than a shingle is one shingle; repeated rows and
ids share a component like any equal texts; with a null id a row counts as the largest of its
component; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.llm.byte_words import mix64, row_shingles, set_key, words_of
from lexmill.llm.components import connected_components
from lexmill.session import Scratch, bounded_batches, written

# shingles with a level, and the most and the least slots (powers of 2) of the table that holds the
# levels, and slots per level
MOST_LEVELS = 1 << 22
LEVEL_SLOTS = 1 << 25
LEAST_SLOTS, LEVEL_ROOM = 1 << 20, 8
# least count of a level; classes 2 and 3 start at these levels
RARE_BELOW = 8
# width of a size cell, as a logarithm, and cells in a wide one
SIZE_CELL = 0.005
WIDE = 4
PAIRS_FROM, TRIPLES_FROM = 1, 5
# prefix shingles per cell
PAIR_CELL, TRIPLE_CELL = 3, 5
SKETCH_CELLS = 256
# bits that mark signatures that occur again (8 MB), and further bits of a counted key
MARK_BITS, KEY_BITS = 26, 12
# sets of a signature that are compared pair by pair at once; more meet around a centre first
PAIRED = 8
# centres that such sets get in turn, and the distance (a fraction) up to which all that a set may
# link with is found around its centre
CENTRES, LEEWAY = 3, (3, 10)
# sets that a task remembers, so that a copy's signatures aren't made again
MOST_SEEN = 1 << 20
# bytes of text, and signatures, that a counting task gets about
COUNT_BYTES, MARK_KEYS = 32_000_000, 4_000_000

_U64 = np.uint64


def _column(batch: pa.RecordBatch, name: str):
    return batch.column(batch.schema.get_field_index(name))


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, _U64).view(np.int64))


# ---------------------------------------------------------------- counts and levels


def _counts(docs: DataFrame, size: int, blocks: int) -> DataFrame:
    """Blocks of shingle keys with their document counts, a row per run of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = [], 0
        for batch in batches:
            for words in words_of(_column(batch, "text")):
                for _, hashes in row_shingles(words, size):
                    found.append(hashes)
                    held += len(hashes)
                if held > 2_000_000:
                    yield from _blocks(found, blocks)
                    found, held = [], 0
        yield from _blocks(found, blocks)

    return docs.select("text").mapInArrow(run, "block int, keys binary, counts binary")


def _block_of(hashes: np.ndarray, blocks: int) -> np.ndarray:
    # 32 bits name the key inside its block, the bits above them the block
    return ((hashes >> _U64(32)) % _U64(blocks)).astype(np.int64)


def _blocks(found: list[np.ndarray], blocks: int) -> Iterator[pa.RecordBatch]:
    if not found:
        return
    hashes = np.concatenate(found)
    if not len(hashes):
        return
    keys = (_block_of(hashes, blocks).astype(_U64) << _U64(32)) | (hashes & _U64(0xFFFFFFFF))
    keys, counts = np.unique(keys, return_counts=True)
    block = (keys >> _U64(32)).astype(np.int32)
    cuts = np.flatnonzero(np.diff(block)) + 1
    low, counts = keys.astype(np.uint32), counts.astype(np.uint32)
    starts = np.concatenate([[0], cuts]).astype(np.int64)
    split = lambda x: pa.array([p.tobytes() for p in np.split(x, cuts)], pa.binary())
    # counts of one, as most are, are left out
    many = [p if (p > 1).any() else p[:0] for p in np.split(counts, cuts)]
    yield pa.RecordBatch.from_arrays(
        [pa.array(block[starts]), split(low), pa.array([p.tobytes() for p in many], pa.binary())],
        ["block", "keys", "counts"],
    )


def _frequent(counted: DataFrame, least: int) -> DataFrame:
    """``block, low, level`` of the shingle keys in at least ``least`` documents."""

    def run(
        key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]
    ) -> Iterator[pa.RecordBatch]:
        keys = np.zeros(0, np.uint32)
        counts = np.zeros(0, np.int64)
        held, waiting = [], 0

        def merged():
            k = np.concatenate([keys, *[x for x, _ in held]])
            c = np.concatenate([counts, *[y for _, y in held]])
            unique, where = np.unique(k, return_inverse=True)
            return unique, np.bincount(where, weights=c, minlength=len(unique)).astype(np.int64)

        for batch in batches:
            for k, c in zip(_column(batch, "keys"), _column(batch, "counts"), strict=True):
                k = np.frombuffer(k.as_py(), np.uint32)
                c = np.frombuffer(c.as_py(), np.uint32).astype(np.int64)
                held.append((k, c if len(c) else np.ones(len(k), np.int64)))
                waiting += len(k)
                if waiting > max(1_000_000, len(keys)):
                    keys, counts = merged()
                    held, waiting = [], 0
        keys, counts = merged()
        often = counts >= least
        keys, counts = keys[often], counts[often]
        level = np.floor(np.log2(counts / least)).astype(np.int32) + 1
        block = np.full(len(keys), key[0].as_py(), np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(block), pa.array(keys.astype(np.int64)), pa.array(level, pa.int32())],
            ["block", "low", "level"],
        )

    return counted.groupBy("block").applyInArrow(run, "block int, low long, level int")


def _slot(block: np.ndarray, low: np.ndarray, slots: int) -> np.ndarray:
    spread = mix64((block.astype(_U64) << _U64(32)) | low.astype(_U64))
    return (spread & _U64(slots - 1)).astype(np.int64)


def _level_table(frequent: DataFrame, most: int, slots: int) -> np.ndarray:
    """One level per slot. If more than ``most`` shingles are frequent, only whole upper levels
    that fit are kept: the others then count as rare, which changes no result. The table has
    ``LEVEL_ROOM`` slots per level, ``slots`` at most."""
    sizes = frequent.groupBy("level").count().orderBy(F.desc("level")).collect()
    total, lowest = 0, 99
    for row in sizes:
        total += row["count"]
        if total > most:
            break
        lowest = row["level"]
    # at most ``most`` rows
    chosen = frequent.filter(F.col("level") >= lowest).select("block", "low", "level").toArrow()
    slots = min(slots, max(LEAST_SLOTS, 1 << (LEVEL_ROOM * len(chosen)).bit_length()))
    table = np.zeros(slots, np.uint8)
    block, low, level = (c.to_numpy() for c in chosen.columns)
    np.maximum.at(table, _slot(block, low, slots), level.astype(np.uint8))
    return table


# ---------------------------------------------------------------- prefixes and signatures


def missing_at_most(n: int, num: int, den: int) -> int:
    """Shingles of a set of ``n`` that a linked set can lack, at similarity ``num / den``."""
    return n - -(-num * n // den)


EQUAL, CLOSE, NEAR, FAR, ANY = range(5)
MOST_PLACES = 1 << 18


def size_cell(n: int) -> int:
    return int(math.log(n) / SIZE_CELL)


def schemes(n: int, num: int, den: int) -> list[tuple[int, int, int, int]]:
    """(scheme, tag, shingles that the prefix must resist, least size under the tag) of a set.

    Sets of sizes ``n`` and ``m`` link only if they share ``num * (n + m) / (num + den)``. A
    set is tagged with its own cell and the next, so that sets of adjacent cells share a tag.
    """
    lacking = lambda m: n - -(-num * (n + m) // (num + den))
    far = missing_at_most(n, num, den)
    out = [(EQUAL, n, lacking(n), n)]
    for kind, width in ((CLOSE, 1), (NEAR, WIDE)):
        cell = size_cell(n) // width
        smallest = lambda c, width=width: max(1, int(math.exp(c * width * SIZE_CELL)))
        some = min(far, max(lacking(smallest(cell - 1)), lacking(n)))
        out += [(kind, tag, some, smallest(tag - 1)) for tag in (cell, cell + 1)]
    own = n.bit_length()
    tags = [own, own + 1] if n * den // num >= 1 << own else [own]
    return out + [(FAR, tag, far, num * (1 << (tag - 1)) // den) for tag in tags]


def signatures(
    hashes: np.ndarray, levels: np.ndarray, num: int, den: int
) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set and, for each, its scheme in 3 bits and above them the place of
    a single shingle in the set's order. ``levels`` is 0 for rare shingles."""
    n = len(hashes)
    need = missing_at_most(n, num, den) + 1
    rare = hashes[levels == 0]  # sorted, as ``hashes`` are
    singles = rare[:need]
    out, kinds = [singles], [(np.arange(len(singles)) << 3) + ANY]
    if len(rare) < need:
        order = np.lexsort((hashes, levels))[len(rare) :]
        hashes, levels = hashes[order], levels[order]
        pairs, triples = np.split(hashes, [int(np.searchsorted(levels, TRIPLES_FROM))])
        for kind, tag, lacking, least in schemes(n, num, den):
            if lacking + 1 > len(rare):
                mark, wanted = _U64(tag * 8 + kind), lacking + 1 - len(rare)
                cells = combination_cells(least, num, den)
                if cells:
                    out.append(np.unique(_combined(pairs, triples, wanted, cells, mark)))
                else:
                    out.append(_marked(hashes[:wanted], mark))
                kinds.append(np.full(len(out[-1]), kind, np.int64))
    return np.concatenate(out), np.concatenate(kinds)


def combination_cells(least: int, num: int, den: int) -> tuple[int, int] | None:
    """Cells for pairs and for triples of sets of ``least`` shingles or more. They cost the
    prefix no more than a linked set keeps; sets too small for that use single shingles."""
    room, about = num * least // den - 1, missing_at_most(least, num, den) + 1
    if room < 3:
        return None
    triples = max(1, min(about // TRIPLE_CELL, room // 4))
    return max(1, min(about // PAIR_CELL, room - 2 * triples)), triples


def _marked(values: np.ndarray, mark: np.uint64) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix64(values + mark * _U64(0xA0761D6478BD642F))


def _combined(
    pairs: np.ndarray, triples: np.ndarray, need: int, cells: tuple[int, int], mark: np.uint64
) -> np.ndarray:
    """Combinations inside cells, of the shortest prefix that resists ``need - 1`` losses."""
    pair_cells, triple_cells = cells
    pair_cell = (mix64(pairs) % _U64(pair_cells)).astype(np.int64)
    triple_cell = (mix64(triples) % _U64(triple_cells)).astype(np.int64)
    gains = np.concatenate([_gain(pair_cell, 2), _gain(triple_cell, 3)])
    end = int(np.searchsorted(np.cumsum(gains), need)) + 1
    if end > len(gains):
        raise AssertionError("a set's combinations can't resist its losses")
    out = [_combinations(pairs[:end], pair_cell[:end], 2, mark)]
    if end > len(pairs):
        k = end - len(pairs)
        out.append(_combinations(triples[:k], triple_cell[:k], 3, mark))
    return np.concatenate(out)


def _gain(cells: np.ndarray, size: int) -> np.ndarray:
    """1 for each shingle from the ``size``-th of its cell on."""
    order = np.argsort(cells, kind="stable")
    ordered = cells[order]
    starts = np.searchsorted(ordered, ordered)
    gains = np.empty(len(cells), np.int64)
    gains[order] = np.arange(len(cells)) - starts >= size - 1
    return gains


def _combinations(hashes: np.ndarray, cells: np.ndarray, size: int, mark) -> np.ndarray:
    order = np.lexsort((hashes, cells))
    hashes, cells = hashes[order], cells[order]
    out = []
    with np.errstate(over="ignore"):
        cuts = np.flatnonzero(np.diff(cells)) + 1
        for group in np.split(hashes, cuts):
            m = len(group)
            if m < size:
                continue
            if size == 2:
                i, j = np.triu_indices(m, 1)
                both = group[i] * _U64(0x9FB21C651E98DF25) + group[j]
            else:
                i, j, k = _triples(m)
                both = (group[i] * _U64(0x9FB21C651E98DF25) + group[j]) * _U64(
                    0xD6E8FEB86659FD93
                ) + group[k]
            out.append(_marked(both, mark))
    return np.concatenate(out) if out else hashes[:0]


_TRIPLES: dict[int, tuple[np.ndarray, ...]] = {}


def _triples(m: int) -> tuple[np.ndarray, ...]:
    if m not in _TRIPLES:
        i, j = np.triu_indices(m, 1)
        reps = m - 1 - j
        a, b = np.repeat(i, reps), np.repeat(j, reps)
        ends = np.cumsum(reps)
        c = np.arange(len(a)) - np.repeat(ends - reps, reps) + b + 1
        if m > 64:
            return a, b, c
        _TRIPLES[m] = (a, b, c)
    return _TRIPLES[m]


def node_key(key: np.uint64, levels: np.ndarray) -> np.uint64:
    """The set's key behind its share of rare shingles in 6 bits: sets made of frequent
    shingles, the least changed of a group of copies, come first. The sign bit stays clear."""
    share = min(62, int(63 * float((levels == 0).mean()))) if len(levels) else 62
    return (_U64(share) << _U64(57)) | (key >> _U64(7))


def _levels_of(hashes: np.ndarray, table: np.ndarray, blocks: int) -> np.ndarray:
    place = _slot(_block_of(hashes, blocks), hashes & _U64(0xFFFFFFFF), len(table))
    return table[place]


def _signed_docs(docs: DataFrame, size: int, num: int, den: int, table, blocks: int) -> DataFrame:
    """``doc_id, node, n, text_key, sketch, sigs, kinds`` of each document. ``sigs`` holds the
    signatures of a set that is new in its task, ``kinds`` the place (bits 3 and above, a later
    place counts as the last) and the scheme of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            at, held = 0, 0
            nodes, ns, sketches, sigs, kinds = [], [], [], [], []

            def rows(batch=batch):
                part = batch.slice(at, len(ns))
                return pa.RecordBatch.from_arrays(
                    [
                        _column(part, "doc_id"), pa.array(nodes, pa.int64()),
                        pa.array(ns, pa.int64()), _column(part, "text_key"),
                        *(pa.array(x, pa.binary()) for x in (sketches, sigs, kinds)),
                    ],
                    ["doc_id", "node", "n", "text_key", "sketch", "sigs", "kinds"],
                )

            for words in words_of(_column(batch, "text")):
                for _, hashes in row_shingles(words, size):
                    n = len(hashes)
                    levels = _levels_of(hashes, table.value, blocks)
                    node = node_key(set_key(hashes), levels)
                    nodes.append(int(node) if n else None)
                    ns.append(n)
                    # a different set links only if one shingle more or less allows it
                    alone = missing_at_most(n, num, den) == 0 and n * den < num * (n + 1)
                    if alone or node in seen:
                        for x in (sketches, sigs, kinds):
                            x.append(None)
                        continue
                    if len(seen) >= MOST_SEEN:
                        seen.clear()
                    seen.add(node)
                    sketches.append(_sketch(hashes))
                    sig, kind = signatures(hashes, levels, num, den)
                    place = np.minimum(kind >> 3, MOST_PLACES - 1)
                    sigs.append(sig.tobytes())
                    kinds.append(((place << 3) + (kind & 7)).astype(np.uint32).tobytes())
                    held += len(sig)
                if held > 500_000:
                    yield rows()
                    at, held = at + len(ns), 0
                    nodes, ns, sketches, sigs, kinds = [], [], [], [], []
            if ns:
                yield rows()

    return docs.mapInArrow(
        run,
        "doc_id long, node long, n long, text_key long, sketch binary, sigs binary, kinds binary",
    )


def _mark_keys(sigs: np.ndarray, part_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Part and key inside it of signatures. A key's first ``MARK_BITS`` bits are its mark."""
    key = mix64(sigs) >> _U64(64 - MARK_BITS - KEY_BITS)
    rest = _U64(MARK_BITS + KEY_BITS - part_bits)
    return (key >> rest).astype(np.int32), (key & ((_U64(1) << rest) - _U64(1))).astype(np.uint64)


def _shared_marks(signed: DataFrame, part_bits: int) -> np.ndarray:
    """A bit per mark: whether a signature key under it is of two sets (or of a set that two
    tasks met) or more."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(sigs.as_buffer(), _U64) for sigs in batch.column(0)]
            part, key = _mark_keys(np.concatenate([np.zeros(0, _U64), *found]), part_bits)
            order = np.argsort(part, kind="stable")
            part, key = part[order], key[order].astype(np.uint32)
            starts = np.flatnonzero(np.diff(part, prepend=-1))
            if len(starts):
                cut = [p.tobytes() for p in np.split(key, starts[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[starts]), pa.array(cut, pa.binary())], ["part", "keys"]
                )

    marks = 1 << (MARK_BITS - part_bits)

    def shared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        raw = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
        value = np.sort(np.concatenate(raw))
        again = value[1:][value[1:] == value[:-1]] >> np.uint32(KEY_BITS)
        bits = np.zeros(marks, bool)
        bits[again] = True
        packed = np.packbits(bits).tobytes()
        return pa.table(
            {"part": pa.array([key[0].as_py()], pa.int32()), "bits": pa.array([packed], pa.binary())}
        )

    found = (
        signed.filter("sigs is not null")
        .select("sigs")
        .mapInArrow(keys, "part int, keys binary")
        .groupBy("part")
        .applyInArrow(shared, "part int, bits binary")
    )
    bits = np.zeros((1 << MARK_BITS) // 8, np.uint8)
    table = found.toArrow()  # the bit array, once
    for part, raw in zip(*table.columns, strict=True):
        bits[part.as_py() * (marks // 8) :][: marks // 8] = np.frombuffer(raw.as_buffer(), np.uint8)
    return bits


def _entries(signed: DataFrame, marks) -> DataFrame:
    """``sig, node, size`` of marked signatures. ``size`` holds the set's size, a single
    shingle's place (18 bits), the size cell (13 bits) and the scheme (3 bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = marks.value
        for batch in batches:
            sigs, owners, sizes = [], [], []
            for node, n, raw, kinds in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), *batch.columns[2:],
                strict=True,
            ):
                sig = np.frombuffer(raw.as_buffer(), _U64)
                mark = (mix64(sig) >> _U64(64 - MARK_BITS)).astype(np.int64)
                keep = (bits[mark >> 3] >> (7 - (mark & 7)).astype(np.uint8)) & 1 == 1
                kind = np.frombuffer(kinds.as_buffer(), np.uint32)[keep].astype(np.int64)
                sigs.append(sig[keep])
                owners.append(np.full(len(kind), node, np.int64))
                sizes.append((n << 34) + (kind >> 3 << 16) + (size_cell(n) << 3) + (kind & 7))
            if sigs:
                yield pa.RecordBatch.from_arrays(
                    [_signed(np.concatenate(sigs)), *(pa.array(np.concatenate(x)) for x in (owners, sizes))],
                    ["sig", "node", "size"],
                )

    rows = signed.filter("sigs is not null").select("node", "n", "sigs", "kinds")
    return rows.mapInArrow(run, "sig long, node long, size long")


# ---------------------------------------------------------------- verification


def _sketch(hashes: np.ndarray) -> bytes:
    """Shingles per hash cell. The sum of the smaller counts is no less than an overlap."""
    counts = np.bincount((mix64(hashes) >> _U64(56)).astype(np.int64), minlength=SKETCH_CELLS)
    return counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes()


def _counts_of(sketch: bytes) -> np.ndarray:
    return np.frombuffer(sketch, np.uint8 if len(sketch) == SKETCH_CELLS else np.uint32)


def _links(overlap: int, m: int, n: int, num: int, den: int) -> bool:
    return den * overlap >= num * (m + n - overlap)


def _with(edges: DataFrame, per_node: DataFrame, column: str) -> DataFrame:
    """``edges`` with ``a_<column>`` and ``b_<column>``."""
    for end in ("b", "a"):
        side = per_node.select(F.col("node").alias(end), F.col(column).alias(f"{end}_{column}"))
        edges = edges.join(side, end)
    return edges


def _possible(edges: DataFrame, sketches: DataFrame, num: int, den: int) -> DataFrame:
    """Edges that sizes and sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_column(batch, "a_sketch"), _column(batch, "b_sketch"), strict=True):
                x, y = _counts_of(x.as_py()), _counts_of(y.as_py())
                most = int(np.minimum(x, y).sum())
                keep.append(_links(most, int(x.sum()), int(y.sum()), num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    paired = _with(edges, sketches, "sketch")
    return paired.mapInArrow(run, "a long, b long")


def _sets_of(docs: DataFrame, wanted: DataFrame, size: int, table, blocks: int) -> DataFrame:
    """``node, shingles`` for the nodes of ``wanted`` (``node, doc_id`` of one document)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            wanted_nodes = _column(batch, "node").to_pylist()
            nodes, blobs, held = [], [], 0
            for words in words_of(_column(batch, "text")):
                for row, hashes in row_shingles(words, size):
                    node = node_key(set_key(hashes), _levels_of(hashes, table.value, blocks))
                    if int(node) == wanted_nodes[row]:
                        nodes.append(int(node))
                        blobs.append(hashes.tobytes())
                        held += len(blobs[-1])
                if held > 8_000_000:
                    yield _set_batch(nodes, blobs)
                    nodes, blobs, held = [], [], 0
            yield _set_batch(nodes, blobs)

    found = docs.join(
        wanted.select(F.col("doc_id").alias("_id"), "node"), docs["doc_id"].eqNullSafe(F.col("_id"))
    )
    return (
        found.select("node", "text")
        .mapInArrow(run, "node long, shingles binary")
        .dropDuplicates(["node"])
    )


def _set_batch(nodes: list[int], blobs: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(nodes, pa.int64()), pa.array(blobs, pa.binary())], ["node", "shingles"]
    )


def _verified(edges: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The edges whose sets link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(_column(batch, "a_shingles"), _column(batch, "b_shingles"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), _U64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                overlap = int((both[1:] == both[:-1]).sum())
                keep.append(_links(overlap, len(x), len(y), num, den))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return _with(edges, sets, "shingles").mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- around a centre


def _differences(spokes: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """``a, b, n, m, apart, excess, core, differ`` of spokes from a centre ``a`` to a set ``b``:
    their sizes, in how many shingles they differ, the shingles, and whether they are near enough
    that ``b`` meets all that it may link with here. ``excess`` is above 0 if they don't link.
    Spokes that are too far for that and for those near the centre are left out."""
    top, bottom = LEEWAY[1] * num - LEEWAY[0] * den, LEEWAY[1] * den

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, len(batch), 256):
                yield rows(batch.slice(part, 256))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        keep, found, differ = [], [], []
        for x, y in zip(_column(batch, "a_shingles"), _column(batch, "b_shingles"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), _U64) for v in (x, y))
            other = np.setxor1d(x, y, assume_unique=True)
            n, m, apart = len(x), len(y), len(other)
            overlap = (n + m - apart) // 2
            keep.append(_links(overlap, n, m, top, bottom))
            if keep[-1]:
                core = _links(overlap, n, m, LEEWAY[1] - LEEWAY[0], LEEWAY[1])
                excess = (den + num) * apart - (den - num) * (n + m)
                found.append((n, m, apart, excess, core))
                differ.append(other.view(np.int64))
        ends = np.cumsum([0, *map(len, differ)]).astype(np.int32)
        flat = np.concatenate([np.zeros(0, np.int64), *differ])
        columns = list(zip(*found, strict=True)) or [()] * 5
        own = batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
        return pa.RecordBatch.from_arrays(
            [
                *own.columns, *(pa.array(c, pa.int64()) for c in columns[:4]),
                pa.array(columns[4], pa.bool_()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            ],
            ["a", "b", "n", "m", "apart", "excess", "core", "differ"],
        )

    return _with(spokes, sets, "shingles").mapInArrow(
        run,
        "a long, b long, n long, m long, apart long, excess long, core boolean, differ array<long>",
    )


def _around_pairs(around: DataFrame, components: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs ``a, b`` of sets around one centre that may link and are in different components.

    Two sets that link differ in ``(den - num) / (den + num)`` of both sizes at most. So of the
    shingles in which they differ from the centre they share no less than half of what
    both numbers exceed that by: at least one, if one of them doesn't link with the centre.
    These shingles are put in order, the least frequent around the centre first, and a prefix of
    each set is enough to find a shared one.
    """
    both, lost = den + num, den - num
    each = around.select("a", "b", F.explode("differ").alias("x"))
    # a shingle of one set alone only counts as a place in its order
    times = each.groupBy("a", "x").agg(F.count(F.lit(1)).alias("times")).filter("times > 1")
    lists = (
        each.join(times, ["a", "x"])
        .groupBy("a", "b")
        .agg(F.array_sort(F.collect_list(F.struct("times", "x"))).alias("order"))
    )
    outside = F.col("excess") > 0
    # what it shares with a set that doesn't link with the centre, and with one that does
    share = F.ceil((F.col("excess") + 1 + 2 * lost * F.col("n")) / (2 * both))
    inner = F.greatest(F.lit(1), F.ceil(F.col("excess") / (2 * den)))
    share = F.when(outside, F.least(share, inner)).otherwise(share)
    placed = (
        around.join(lists, ["a", "b"])
        .withColumns({"alone": F.col("apart") - F.size("order"), "prefix": F.col("apart") - share + 1})
        .withColumn("order", F.expr("slice(`order`, 1, cast(greatest(prefix - alone, 0) AS int))"))
        .select("a", "b", "m", "apart", "excess", "alone", F.posexplode("order").alias("i", "s"))
        .join(components, "b", "left")
        .select(
            "a", F.col("s.x").alias("x"), "b", "m", "apart", "excess",
            (F.col("apart") - F.col("alone") - F.col("i")).alias("left"),
            F.coalesce("b_of", "b").alias("of"),
        )
    )
    one, two = (
        placed.select("a", "x", *(F.col(c).alias(f"{c}{k}") for c in ("b", "m", "apart", "excess", "left", "of")))
        for k in "12"
    )
    needed = both * (F.col("apart1") + F.col("apart2")) - lost * (F.col("m1") + F.col("m2"))
    return (
        one.filter("excess1 > 0")
        .join(two, ["a", "x"])
        .filter((F.col("excess2") <= 0) | (F.col("b1") < F.col("b2")))
        .filter((F.col("of1") != F.col("of2")) & (2 * both * F.least("left1", "left2") >= needed))
        .select(F.least("b1", "b2").alias("a"), F.greatest("b1", "b2").alias("b"))
        .distinct()
    )


# ---------------------------------------------------------------- the join


def jaccard_classes(
    docs: DataFrame,
    size: int = 5,
    similarity: tuple[int, int] = (4, 5),
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``doc_id, n_shingles, component_id, text_key`` of every row of ``docs``.

    ``text_key`` is the text's 64-bit hash, to find rows again whose id is null or not unique.
    ``similarity`` is a fraction; sets link at that Jaccard similarity or more. The component
    is named by the smallest id that is reachable by links.
    """
    num, den = similarity
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.col(text).alias("text"),
        F.xxhash64(text).alias("text_key"),
    )
    scratch = Scratch()
    written = scratch.written
    # as many blocks as the texts need
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes // COUNT_BYTES)

    frequent = written(_frequent(_counts(docs, size, blocks), RARE_BELOW), "levels")
    table = spark.sparkContext.broadcast(_level_table(frequent, MOST_LEVELS, LEVEL_SLOTS))
    scratch.drop(frequent)
    signed = written(_signed_docs(docs, size, num, den, table, blocks), "signatures")
    rows = written(signed.drop("sigs", "kinds"), "rows")
    made = signed.agg(F.sum(F.octet_length("sigs"))).first()[0] or 0
    part_bits = min(20, max(6, int(made // 8 // MARK_KEYS).bit_length()))
    marks = spark.sparkContext.broadcast(_shared_marks(signed, part_bits))
    classes = written(
        rows.filter("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id")), "classes"
    )

    def fits(x: str, y: str):
        """Whether two sizes of one signature are of its scheme and may link at all.

        A single shingle only counts where it may be the first that two linked sets share:
        no more than what follows it in either order can be shared then.
        """
        n, m = F.shiftright(x, 34), F.shiftright(y, 34)
        place = lambda c: F.shiftright(c, 16) % MOST_PLACES
        first = F.least(n - place(x), m - place(y)) * (num + den) >= num * (n + m)
        cell = lambda c, width: F.floor(F.shiftright(c, 3) % 8192 / width)
        close = F.abs(cell(x, 1) - cell(y, 1)) <= 1
        near = F.abs(cell(x, WIDE) - cell(y, WIDE)) <= 1
        kind = F.col(x) % 8
        of_scheme = (
            F.when(kind == CLOSE, (n != m) & close)
            .when(kind == NEAR, ~close & near)
            .when(kind == FAR, ~near)
            .when(kind == ANY, first)
            .otherwise(True)
        )
        return of_scheme & (F.least(n, m) * den >= F.greatest(n, m) * num)

    entries = written(_entries(signed, marks), "entries")
    marks.destroy()
    scratch.drop(signed)
    pivots = (
        entries.groupBy("sig")
        .agg(F.min(F.struct("node", "size")).alias("least"), F.max("node").alias("other"))
        .select("sig", F.col("least.node").alias("pivot"), F.col("least.size").alias("pivot_size"), "other")
        .filter("pivot != other")
        .drop("other")
    )
    members = written(entries.join(pivots, "sig").distinct(), "members")
    scratch.drop(entries)

    def compared(edges: DataFrame, least: tuple[int, int]) -> tuple[DataFrame, DataFrame]:
        """The edges that may be as similar as ``least``, and the sets at their ends."""
        nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        sketches = (
            rows.filter("sketch is not null")
            .select("node", "sketch")
            .join(nodes, "node", "left_semi")
            .dropDuplicates(["node"])
        )
        likely = written(_possible(edges, sketches, *least), "likely")
        nodes = likely.select(F.col("a").alias("node")).union(likely.select("b")).distinct()
        wanted = classes.join(nodes, "node", "left_semi")
        return likely, written(_sets_of(docs, wanted, size, table, blocks), "sets")

    def verified(edges: DataFrame) -> DataFrame:
        likely, sets = compared(edges, (num, den))
        links = written(_verified(likely, sets, num, den), "links")
        scratch.drop(likely, sets)
        return links

    stars = written(
        members.filter((F.col("node") != F.col("pivot")) & fits("size", "pivot_size"))
        .select(F.col("pivot").alias("a"), F.col("node").alias("b"))
        .distinct(),
        "stars",
    )
    # an edge per set; then the others that still join two components
    least = written(stars.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "least")
    links = verified(least)
    components = written(connected_components(links), "components")

    def component(end: str):
        return components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_of"))

    def merged(more: DataFrame) -> DataFrame:
        """The components with further links, which join whole components. The old ones go."""
        between = more.join(component("a"), "a", "left").join(component("b"), "b", "left")
        joined = written(
            connected_components(
                between.select(F.coalesce("a_of", "a").alias("a"), F.coalesce("b_of", "b").alias("b"))
            ),
            "joined",
        )
        known = components.join(
            joined.select(F.col("node").alias("component"), F.col("component").alias("to")),
            "component", "left",
        )
        new = joined.join(components.select("node"), "node", "left_anti")
        found = written(
            known.select("node", F.coalesce("to", "component").alias("component")).unionByName(new),
            "components",
        )
        scratch.drop(components, joined)
        return found

    untried = written(
        stars.join(least, ["a", "b"], "left_anti")
        .join(component("a"), "a", "left")
        .join(component("b"), "b", "left")
        .filter(F.coalesce("a_of", "a") != F.coalesce("b_of", "b"))
        .select("a", "b"),
        "untried",
    )
    scratch.drop(stars, least)
    scratch.drop(links)
    if not untried.isEmpty():
        others = verified(untried)
        components = merged(others)
        scratch.drop(others)
    scratch.drop(untried)

    def apart(sets: DataFrame) -> DataFrame:
        """``sig, node, size, component`` of the signatures whose sets aren't all connected."""
        placed = sets.join(components, "node", "left").withColumn(
            "component", F.coalesce("component", "node")
        )
        several = (
            placed.groupBy("sig")
            .agg(F.min("component").alias("x"), F.max("component").alias("y"))
            .filter("x != y")
            .select("sig")
        )
        return written(placed.join(several, "sig"), "rest")

    # a pivot has met all others of its signature; of those left, many meet around a centre
    rest = apart(members.filter("node != pivot").select("sig", "node", "size"))
    scratch.drop(members)
    few = []
    for turn in range(CENTRES):
        # at first the root of the least component, which most signatures of a group of copies
        # have in common, then the least of the sets that were far from it
        groups = rest.groupBy("sig").agg(
            F.count(F.lit(1)).alias("sets"),
            F.min("node" if turn else "component").alias("centre"),
        )
        facing = written(rest.drop("component").join(groups, "sig"), "facing")
        scratch.drop(rest)
        few.append(facing.filter(F.col("sets") <= PAIRED).select("sig", "node", "size"))
        many = facing.filter(F.col("sets") > PAIRED)
        if many.isEmpty():
            rest = None
            break
        spokes = written(
            many.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "spokes"
        )
        near, sets = compared(spokes, (LEEWAY[1] * num - LEEWAY[0] * den, LEEWAY[1] * den))
        around = written(_differences(near, sets, num, den), "around")
        linked = around.filter("excess <= 0").select("a", "b")
        linked = linked.join(component("a"), "a", "left").join(component("b"), "b", "left")
        linked = linked.filter(F.coalesce("a_of", "a") != F.coalesce("b_of", "b")).select("a", "b")
        pairs = written(_around_pairs(around, component("b"), num, den), "pairs")
        more = written(linked.union(_verified(pairs, sets, num, den)), "links")
        scratch.drop(near, sets, pairs)
        if not more.isEmpty():
            components = merged(more)
        scratch.drop(more)
        core = around.filter("core").select(F.col("a").alias("centre"), F.col("b").alias("node"))
        far = many.join(core, ["centre", "node"], "left_anti").select("sig", "node", "size")
        rest = apart(far)
        scratch.drop(spokes, around)
        if rest.isEmpty():
            break
    far = few[0] if rest is None else rest.select("sig", "node", "size").union(few[0])
    for part in few[1:]:
        far = far.union(part)
    rest = apart(far)
    left, right = (
        rest.select(
            "sig", F.col("node").alias(n), F.col("component").alias(f"{n}_of"),
            F.col("size").alias(f"{n}_size"),
        )
        for n in ("a", "b")
    )
    pairs = (
        left.join(right, "sig")
        .filter((F.col("a") < F.col("b")) & (F.col("a_of") != F.col("b_of")) & fits("a_size", "b_size"))
        .select("a", "b")
        .distinct()
    )
    if not rest.isEmpty():
        pairs = written(pairs, "pairs")
        more = verified(pairs)
        components = merged(more)
        scratch.drop(pairs, more)
    scratch.drop(rest)
    # the table is read by no plan any more
    table.destroy()

    named = classes.join(components, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )
    firsts = named.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named = written(named.join(firsts, "component").select("node", "component_id"), "named")
    scratch.drop(classes, components)
    return (
        rows.select("doc_id", "node", "text_key", F.col("n").alias("n_shingles"))
        .join(named, "node", "left")
        .select(
            "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
            "text_key",
        )
    )


def first_of_each_class(
    docs: DataFrame, classes: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One document of each class of ``jaccard_classes``: that whose id names it.

    A repeated row stays once. Rows without id stay if no row of their class has one.
    """
    kept = written(
        classes.filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"))
        .agg(F.count(F.lit(1)).alias("n")),
        "kept",
    )
    found = docs.join(
        kept, docs[doc_id].eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_key")), "left_semi"
    )
    if kept.filter("n > 1").isEmpty():
        return found
    return found.dropDuplicates([doc_id, text])
