"""Ranked lexical search: the best documents of each item, by ball trees over sparse vectors.

A document is a vector of term scores ``weight * saturated count``, an item a vector of term
counts, and a document's score for an item their inner product, in 64-bit integers. Only the
coordinates that some item has are kept: no other touches a score.

Items are taken in blocks of ``ITEM_BLOCK``, whose terms are broadcast (a stated query set in
blocks against all rows). One pass over the texts keeps each document's length and its counts of
those terms; all statistics come from that table. Documents are range-sorted by their two
heaviest terms, so that neighbours are alike and a term that a third of all documents share is
still split by id, and are cut into blocks of at most ``BLOCK_DOCS`` rows and ``BLOCK_ENTRIES``
terms. Each block becomes a ball tree: the documents are split by their projection on two far
apart members until ``LEAF`` are left, and stored in that order.

A node is bounded by its centroid and radii: the ball's radius, by the Cauchy-Schwarz inequality,
and one radius per term, which is the same bound for one coordinate at a time and much the
tighter one where a node holds few of an item's rare terms. The lesser of both, widened by more
than the rounding of doubles, is compared with the item's k-th best score so far. A subtree whose
bound is below it is left out; the others are opened best first, and leaves are scored in
integers. First the blocks are ranked by the bounds of their roots, and each item's ``SEEDS`` best
are searched; their k-th scores are broadcast (a number per item) and then all blocks are searched,
of which most end at the root or soon after. Each task returns its best k per item, and a window
with a map-side limit ranks them.

Terms are compared by a 64-bit hash of their bytes with A to Z lower-cased.

Defined cases. A document without a term, or null, counts nowhere. Documents without an id count
in the statistics but are not returned. Equal scores go by id; repeated rows are ranked each.
Only scores above 0 are returned. An item without a known term, or a null one, has no rows;
repeated items are ranked each. Empty tables give no rows. Further columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.byte_words import PUNCTUATED, words_of
from lexmill.llm.ranked import Best
from lexmill.session import bounded_batches, new_folder, numbered, spread, task_count, written

ITEM_BLOCK = 4096
BLOCK_DOCS = 1024
BLOCK_ENTRIES = 1 << 17
LEAF = 16
SEEDS = 2
# Bounds are widened by this share of their terms, far above the rounding of doubles.
SAFE = 1e-9

_COUNTS = "terms long, codes array<int>, counts array<int>"
_BLOCK = (
    "block string, ids array<long>, sizes array<int>, codes array<int>, values array<int>, "
    "first array<int>, last array<int>, left array<int>, radius array<double>"
)


class Queries(NamedTuple):
    """Items of a block: item i has the terms ``codes[offsets[i]:offsets[i + 1]]``."""

    offsets: np.ndarray
    codes: np.ndarray
    counts: np.ndarray
    weights: np.ndarray  # of every code


# --- counts ------------------------------------------------------------------------


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for words in words_of(batch.column(1), PUNCTUATED):
            row = np.repeat(np.arange(words.rows), np.diff(words.first))
            pairs = np.stack([row.astype(np.uint64), words.hashes], axis=1)
            pairs, count = np.unique(pairs, axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(words.start + pairs[:, 0].astype(np.int64))),
                    pa.array(pairs[:, 1].view(np.int64)),
                    pa.array(count.astype(np.int64)),
                ],
                ["number", "term", "count"],
            )


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _counter(shared):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value  # sorted hashes
        for batch in batches:
            for words in words_of(batch.column(1), PUNCTUATED):
                at = np.searchsorted(vocabulary, words.hashes)
                at[at == len(vocabulary)] = 0
                known = vocabulary[at] == words.hashes
                terms = np.diff(words.first)
                row = np.repeat(np.arange(words.rows), terms)[known]
                key, times = np.unique(
                    row * len(vocabulary) + at[known], return_counts=True
                )
                row, code = np.divmod(key, len(vocabulary))
                sizes = np.bincount(row, minlength=words.rows)
                some = np.flatnonzero(terms)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(words.start + some)),
                        pa.array(terms[some].astype(np.int64)),
                        _lists(code.astype(np.int32), sizes[some]),
                        _lists(times.astype(np.int32), sizes[some]),
                    ],
                    ["id", "terms", "codes", "counts"],
                )

    return count


def term_weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def saturated(counts: np.ndarray, terms: np.ndarray, documents: int, total: int) -> np.ndarray:
    """The value of a term that occurs ``counts`` times in a document of ``terms`` terms."""
    length = 100 - 25 + (25 * terms * documents) // total
    return (1_000_000_000 * counts) // (1000 * counts + 12 * length)


def _weigher(weights, documents: int, total: int):
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = weights.value
        for batch in batches:
            ids, terms, codes, counts = batch.columns
            sizes = codes.value_lengths().to_numpy().astype(np.int64)
            code = codes.flatten().to_numpy()
            terms = np.repeat(terms.to_numpy(), sizes)
            value = saturated(counts.flatten().to_numpy().astype(np.int64), terms, documents, total)
            starts = np.cumsum(sizes) - sizes
            heavy = value * weight[code]
            keys = []
            for _ in range(2):
                top = np.repeat(np.maximum.reduceat(heavy, starts), sizes)
                at = np.where(heavy == top, np.arange(len(heavy)), len(heavy))
                at = np.minimum.reduceat(at, starts)
                keys.append(pa.array(code[at]))
                heavy[at] = np.iinfo(np.int64).min
            yield pa.RecordBatch.from_arrays(
                [ids, *keys, codes, _lists(value.astype(np.int32), sizes)],
                ["id", "first_key", "second_key", "codes", "values"],
            )

    return weigh


# --- ball trees --------------------------------------------------------------------


class Rows:
    """Sparse rows over the terms of a block."""

    def __init__(self, sizes, codes, values) -> None:
        self.sizes, self.codes, self.values = sizes, codes, values
        self.starts = np.cumsum(sizes) - sizes

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.codes] * self.values, self.starts)

    def take(self, rows: np.ndarray) -> Rows:
        sizes = self.sizes[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) + np.repeat(self.starts[rows] - (ends - sizes), sizes)
        return Rows(sizes, self.codes[at], self.values[at])

    def dense(self, row: int, width: int) -> np.ndarray:
        out = np.zeros(width)
        part = slice(self.starts[row], self.starts[row] + self.sizes[row])
        out[self.codes[part]] = self.values[part]
        return out


class Node(NamedTuple):
    first: int
    last: int
    left: int  # number of the left child, the right one follows it; -1: a leaf
    radius: float


def ball_tree(rows: Rows, width: int, leaf: int = LEAF) -> tuple[np.ndarray, list[Node]]:
    """Order of the rows and the nodes of their tree, the root first. Every row has a term."""
    n = len(rows.sizes)
    order = np.arange(n)
    nodes: list[Node | None] = [None]
    todo = [(0, 0, n, rows)]
    while todo:
        number, first, last, part = todo.pop()
        m = last - first
        squares = np.add.reduceat(part.values.astype(float) ** 2, part.starts)
        centroid = np.bincount(part.codes, weights=part.values, minlength=width) / m

        def distance(to, part=part, squares=squares):
            return np.maximum(squares - 2 * part.dot(to) + (to**2).sum(), 0)

        away = distance(centroid)
        # the difference of large squares may lose what is near zero
        radius = math.sqrt(away.max() + SAFE * (squares.max() + (centroid**2).sum()))
        if m <= leaf:
            nodes[number] = Node(first, last, -1, radius)
            continue
        a = part.dense(int(away.argmax()), width)
        b = part.dense(int(distance(a).argmax()), width)
        split = np.argsort(part.dot(a - b), kind="stable")
        left = len(nodes)
        nodes[number] = Node(first, last, left, radius)
        nodes += [None, None]
        order[first:last] = order[first:last][split]
        middle = m // 2
        todo.append((left, first, first + middle, part.take(split[:middle])))
        todo.append((left + 1, first + middle, last, part.take(split[middle:])))
    return order, nodes


def _indexer(weights):
    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        weight = weights.value
        task, made = TaskContext.get().partitionId(), 0

        def block(ids, sizes, codes, values):
            nonlocal made
            terms, local = np.unique(codes, return_inverse=True)
            scores = (values.astype(np.int64) * weight[codes]).astype(float)
            order, nodes = ball_tree(Rows(sizes, local, scores), len(terms))
            sorted_ = Rows(sizes, codes, values).take(order)
            made += 1
            first, last, left, radius = zip(*nodes, strict=True)
            row = {
                "block": f"{task}-{made}", "ids": ids[order], "sizes": sorted_.sizes,
                "codes": sorted_.codes, "values": sorted_.values,
                "first": first, "last": last, "left": left, "radius": radius,
            }
            kinds = {"ids": pa.int64(), "radius": pa.float64()}
            return pa.RecordBatch.from_arrays(
                [pa.array([row["block"]])]
                + [
                    pa.array([row[k]], pa.list_(kinds.get(k, pa.int32())))
                    for k in row
                    if k != "block"
                ],
                list(row),
            )

        held, docs, entries = [], 0, 0
        for batch in batches:
            ids, codes, values = batch.columns
            sizes = codes.value_lengths().to_numpy().astype(np.int64)
            upto = np.concatenate([[0], np.cumsum(sizes)])
            code, value = codes.flatten().to_numpy(), values.flatten().to_numpy()
            ids, at = ids.to_numpy(), 0
            while at < len(ids):
                end = int(np.searchsorted(upto, upto[at] + BLOCK_ENTRIES - entries, "right")) - 1
                end = min(max(end, at + (docs == 0)), at + BLOCK_DOCS - docs, len(ids))
                if end > at:
                    part = slice(upto[at], upto[end])
                    held.append((ids[at:end], sizes[at:end], code[part], value[part]))
                    docs, entries = docs + end - at, entries + int(upto[end] - upto[at])
                if end < len(ids) or docs == BLOCK_DOCS:
                    yield block(*map(np.concatenate, zip(*held, strict=True)))
                    held, docs, entries = [], 0, 0
                at = end
        if held:
            yield block(*map(np.concatenate, zip(*held, strict=True)))

    return index


class Block:
    """A block of the index with the bounds of its nodes."""

    def __init__(self, row: dict, queries: Queries) -> None:
        self.name, self.ids = row["block"], row["ids"]
        self.first, self.last, self.left = row["first"], row["last"], row["left"]
        self.radius = row["radius"]
        sizes = row["sizes"].astype(np.int64)
        self.terms, codes = np.unique(row["codes"], return_inverse=True)
        scores = row["values"].astype(np.int64) * queries.weights[row["codes"]]
        self.rows = Rows(sizes, codes, scores)
        # the queries' terms as terms of the block
        at = np.searchsorted(self.terms, queries.codes)
        at[at == len(self.terms)] = 0
        self.here = np.flatnonzero(self.terms[at] == queries.codes)
        self.at = at[self.here]
        self.count = queries.counts[self.here]
        self.offsets = np.searchsorted(self.here, queries.offsets)
        self.upper = None

    def root_bounds(self) -> np.ndarray:
        """Bound of the whole block for every query."""
        width, n = len(self.terms), len(self.ids)
        codes, scores = self.rows.codes, self.rows.values.astype(float)
        centroid = np.bincount(codes, weights=scores, minlength=width) / n
        held = np.bincount(codes, minlength=width) < n
        most = np.where(held, 0.0, -np.inf)
        np.maximum.at(most, codes, scores)
        least = np.where(held, 0.0, np.inf)
        np.minimum.at(least, codes, scores)
        upper = centroid + np.maximum(most - centroid, centroid - least)
        return self._bounds(upper[None], centroid[None], self.radius[:1])[0]

    def _bounds(self, upper, centroid, radius) -> np.ndarray:
        """nodes x queries, for all queries; the lesser of both bounds, widened."""
        per_term = upper[:, self.at] * self.count
        per_ball = centroid[:, self.at] * self.count
        slack = np.abs(per_term) + np.abs(per_ball)
        sums = [np.concatenate([np.zeros((len(x), 1)), x], axis=1).cumsum(axis=1)
                for x in (per_term, per_ball, slack)]
        term, ball, slack = (x[:, self.offsets[1:]] - x[:, self.offsets[:-1]] for x in sums)
        # differences of running sums: the rounding is that of the whole sum
        slack = slack + sums[2][:, -1:] * 1e-3
        squares = np.concatenate([[0], np.cumsum(self.count.astype(float) ** 2)])
        norm = np.sqrt(squares[self.offsets[1:]] - squares[self.offsets[:-1]])
        ball = ball + radius[:, None] * norm[None, :] * (1 + SAFE)
        return np.minimum(term, ball) + SAFE * slack + 1

    def _tables(self) -> None:
        """Centroid and upper end of every node's terms, from the leaves up."""
        width, nodes = len(self.terms), len(self.first)
        row = np.repeat(np.arange(len(self.ids)), self.rows.sizes)
        leaves = np.flatnonzero(self.left < 0)
        leaves = leaves[np.argsort(self.first[leaves])]
        leaf = np.searchsorted(self.first[leaves], row, side="right") - 1
        key = leaf * width + self.rows.codes
        order = np.argsort(key, kind="stable")
        key, scores = key[order], self.rows.values[order].astype(float)
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        held = np.diff(np.append(starts, len(key)))
        node, term = leaves[key[starts] // width], key[starts] % width
        total = np.zeros((nodes, width))
        most, least = np.zeros((nodes, width)), np.zeros((nodes, width))
        total[node, term] = np.add.reduceat(scores, starts)
        some = held < (self.last - self.first)[node]
        high, low = np.maximum.reduceat(scores, starts), np.minimum.reduceat(scores, starts)
        most[node, term] = np.where(some, np.maximum(high, 0), high)
        least[node, term] = np.where(some, np.minimum(low, 0), low)
        for i in range(nodes - 1, -1, -1):  # children have larger numbers
            j = self.left[i]
            if j >= 0:
                total[i] = total[j] + total[j + 1]
                np.maximum(most[j], most[j + 1], out=most[i])
                np.minimum(least[j], least[j + 1], out=least[i])
        centroid = total / (self.last - self.first)[:, None]
        self.upper = centroid + np.maximum(most - centroid, centroid - least)
        self.centroid = centroid

    def search(self, query: int, best: Best, low: int) -> tuple[int, int]:
        """Add the query's documents of at least ``low`` to its list; the new ``low`` and the
        number of documents scored."""
        if self.upper is None:
            self._tables()
        part = slice(self.offsets[query], self.offsets[query + 1])
        at, count = self.at[part], self.count[part].astype(float)
        upper, centroid = self.upper[:, at], self.centroid[:, at]
        slack = (np.abs(upper) + np.abs(centroid)) @ count
        ball = centroid @ count + self.radius * math.sqrt((count**2).sum()) * (1 + SAFE)
        bound = np.minimum(upper @ count, ball) + SAFE * slack + 1
        dense = np.zeros(len(self.terms), np.int64)
        dense[at] = self.count[part]
        scored = 0
        heap = [(-bound[0], 0)]
        while heap and -heap[0][0] >= low:
            _, i = heapq.heappop(heap)
            j = self.left[i]
            if j >= 0:
                heapq.heappush(heap, (-bound[j], int(j)))
                heapq.heappush(heap, (-bound[j + 1], int(j + 1)))
                continue
            a, b = int(self.first[i]), int(self.last[i])
            starts = self.rows.starts[a:b]
            inside = slice(starts[0], starts[-1] + self.rows.sizes[b - 1])
            scores = np.add.reduceat(
                dense[self.rows.codes[inside]] * self.rows.values[inside], starts - starts[0]
            )
            scored += b - a
            good = np.flatnonzero(scores >= low)
            if len(good):
                worst = best.add(query, self.ids[a + good], scores[good])
                low = low if worst is None else max(low, worst)
        return low, scored


def _blocks(batches: Iterator[pa.RecordBatch], queries: Queries) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = {"block": batch.column("block")[i].as_py()}
            for name in batch.schema.names[1:]:
                row[name] = batch.column(name)[i].values.to_numpy()
            yield Block(row, queries)


def _ranker(shared, seeds: int):
    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        n = len(queries.offsets) - 1
        bounds = np.full((n, seeds), -np.inf)
        names = np.full((n, seeds), None, object)
        for block in _blocks(batches, queries):
            bound = block.root_bounds()
            touched = np.diff(block.offsets) > 0
            place = bounds.argmin(axis=1)
            better = np.flatnonzero(touched & (bound > bounds[np.arange(n), place]))
            bounds[better, place[better]] = bound[better]
            names[better, place[better]] = block.name
        query, place = np.nonzero(np.isfinite(bounds))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(query.astype(np.int32)),
                pa.array(names[query, place].tolist(), pa.string()),
                pa.array(bounds[query, place]),
            ],
            ["query", "block", "bound"],
        )

    return rank


def _searcher(shared, floors, k: int, wanted=None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        low = np.maximum(floors.value, 1).copy()
        best = Best(len(low), k)
        scored = 0
        for block in _blocks(batches, queries):
            # a query without a term here scores 0
            ask = np.diff(block.offsets) > 0
            if wanted is not None:
                mask = np.zeros(len(low), bool)
                mask[wanted.value.get(block.name, [])] = True
                ask &= mask
            if ask.any():
                ask &= block.root_bounds() >= low
            for query in np.flatnonzero(ask):
                low[query], n = block.search(int(query), best, int(low[query]))
                scored += n
        query, ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(query.astype(np.int32)), pa.array(ids), pa.array(scores)],
            ["query", "doc_id", "score"],
        )
        # one row of no query says how many documents were scored
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([0], pa.int64()), pa.array([scored], pa.int64())],
            ["query", "doc_id", "score"],
        )

    return search


# --- search ------------------------------------------------------------------------


def _queries(terms: DataFrame, items: int, first: int):
    """The block's terms as arrays, codes in the order of their hashes."""
    rows = terms.select("number", "term", "count").toPandas()
    number = rows["number"].to_numpy(np.int64) - first
    hashes = rows["term"].to_numpy(np.int64).view(np.uint64)
    vocabulary, codes = np.unique(hashes, return_inverse=True)
    order = np.lexsort((codes, number))
    offsets = np.searchsorted(number[order], np.arange(items + 1))
    return vocabulary, Queries(offsets, codes[order], rows["count"].to_numpy(np.int64)[order], None)


def _index(counts: DataFrame, vocabulary: np.ndarray):
    """(weight per code, index table) of counted documents; None without documents."""
    spark = counts.sparkSession
    documents, total, entries = counts.agg(
        F.count(F.lit(1)), F.sum("terms"), F.sum(F.size("codes"))
    ).first()
    if not documents:
        return None
    # as many rows as terms of the items
    held = counts.select(F.explode("codes").alias("code")).groupBy("code").count().collect()
    weights = np.full(len(vocabulary), 0, np.int64)
    for r in held:
        weights[r["code"]] = term_weight(documents, r["count"])
    shared = spark.sparkContext.broadcast(weights)
    weighed = counts.filter(F.col("id").isNotNull() & (F.size("codes") > 0)).mapInArrow(
        _weigher(shared, documents, total),
        "id long, first_key int, second_key int, codes array<int>, values array<int>",
    )
    keys = ["first_key", "second_key", "id"]
    tasks = max(task_count(spark), entries // (64 * BLOCK_ENTRIES))
    ordered = weighed.repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    blocks = ordered.select("id", "codes", "values").mapInArrow(_indexer(shared), _BLOCK)
    return weights, written(blocks, "index")


def search_documents(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    item_block: int = ITEM_BLOCK,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` best documents."""
    spark = docs.sparkSession
    bounded_batches(spark)
    asked = items.select(F.col(item_col).alias("item_id"), F.col(text_col).alias("_text"))
    asked = written(
        numbered(asked, [F.col("item_id"), F.col("_text")]).withColumn(
            "number", F.col("number") - 1
        ),
        "items",
    )
    terms = written(
        asked.select("number", "_text").mapInArrow(
            _item_terms, "number int, term long, count long"
        ),
        "item_terms",
    )
    texts = spread(docs.select(F.col(doc_col).cast("long").alias("id"), text_col), "id")
    folder = new_folder(spark, "ranked")
    found = "number int, doc_id long, score long"
    spark.createDataFrame([], found).write.parquet(f"{folder}/none")
    count = asked.count()
    for first in range(0, count, item_block):
        here = terms.filter(F.col("number").between(first, first + item_block - 1))
        size = min(item_block, count - first)
        vocabulary, queries = _queries(here, size, first)
        if not len(vocabulary):
            continue
        shared = spark.sparkContext.broadcast(vocabulary)
        counts = written(texts.mapInArrow(_counter(shared), f"id long, {_COUNTS}"), "counts")
        built = _index(counts, vocabulary)
        if built is None:
            break
        weights, index = built
        ranked = _search(index, queries._replace(weights=weights), k)
        ranked.select((F.col("query") + first).alias("number"), "doc_id", "score").write.parquet(
            f"{folder}/{first}"
        )
    reader = spark.read.schema(found).option("recursiveFileLookup", True)
    place = Window.partitionBy("number").orderBy(F.desc("score"), "doc_id")
    ranked = (
        reader.parquet(folder).withColumn("rank", F.row_number().over(place)).filter(F.col("rank") <= k)
    )
    return ranked.join(asked.select("number", "item_id"), "number").select(
        "item_id", "rank", "doc_id", "score"
    )


def _search(index: DataFrame, queries: Queries, k: int) -> DataFrame:
    spark = index.sparkSession
    send = spark.sparkContext.broadcast
    items = len(queries.offsets) - 1
    shared = send(queries)
    best = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    # SEEDS rows per item
    seeds = (
        index.mapInArrow(_ranker(shared, SEEDS), "query int, block string, bound double")
        .withColumn("place", F.row_number().over(best))
        .filter(F.col("place") <= SEEDS)
        .collect()
    )
    wanted: dict[str, list[int]] = {}
    for r in seeds:
        wanted.setdefault(r["block"], []).append(r["query"])
    result = "query int, doc_id long, score long"
    floors = np.zeros(items, np.int64)
    place = Window.partitionBy("query").orderBy(F.desc("score"))
    if wanted:
        first = index.filter(F.col("block").isin(list(wanted)))
        kth = (
            first.mapInArrow(_searcher(shared, send(floors), k, send(wanted)), result)
            .filter("query >= 0")
            .withColumn("place", F.row_number().over(place))
            .filter(F.col("place") == k)
            .collect()
        )
        for r in kth:
            floors[r["query"]] = r["score"]
    return index.mapInArrow(_searcher(shared, send(floors), k), result).filter("query >= 0")
