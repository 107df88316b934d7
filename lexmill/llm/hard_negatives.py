"""Hard negatives of anchor vectors, by exact integer scores bounded along a spanning tree.

Vectors become integers (``floor(scale * x)``) and a score is an inner product. An anchor's
positives are the best rows of its label; a positive's hard negatives are the best rows of other
labels whose score lies in a window below the positive's own.

Anchors are taken in blocks of ``block`` (a stated query set in blocks against all rows): a block
is numbered, its anchors are tied by a minimum spanning tree, and both are broadcast, 4,096
anchors with their vectors at most. Two passes over the candidates then run in ``mapInArrow``,
without a shuffle of vectors: the first finds the positives along one tree per label, the second
the negatives along one tree of all. In a task, only the root is scored against every candidate.
A child's score lies within its parent's plus or minus the edge's length times the candidate's
norm; where that interval misses the window, the pair is not scored, and the interval, not a
score, goes on to the next children. Windows close in as better rows are found. Pairs left over
are scored as one matrix product of the anchors and candidates they involve. Edges join nearest
anchors, so copies and near copies among the anchors cost next to nothing; anchors that have no
near anchor get wide intervals and most of their candidates are scored.

A task sends the best rows per anchor or positive, and a window with a map-side limit keeps the
best of all. Memory per task: anchors of a block times a slice of candidates (``CELLS``).

Defined cases. Rows with a null id, a null label, a null vector, or a null or non-finite
component take no part. Vectors of different lengths are filled up with zeros; an empty one
scores 0. Equal scores go by id. Rows with the anchor's own id are no others; an anchor id that
occurs more than once counts once, with its smallest (label, vector); repeated candidates count
each. Scores are exact up to 2**53. Without positives, or negatives in the
window, an anchor has no rows; no anchors, no rows. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.ranked import Best
from lexmill.session import new_folder, numbered, written

# Anchors broadcast at once.
ANCHOR_BLOCK = 4096
# Cells of the interval matrices inside a task: anchors times candidates of a slice.
CELLS = 1 << 20
# Bounds are widened by this share, far above the rounding of doubles.
SAFE = 1e-9
# Sums of products below this are exact in doubles.
_EXACT = 2.0**52

RESULT = (
    "anchor_id long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


class Tree(NamedTuple):
    """A spanning tree in levels: a node's parent is in an earlier level."""

    root: int
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # nodes, parents, edge lengths


def integer_vector(vector: Column, scale: int = 256) -> Column:
    """``floor(scale * x)`` of every component, x as double."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


def usable(label: Column, vector: Column) -> Column:
    """Whether a row takes part."""
    finite = F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf")))
    )
    # nan compares as larger than infinity
    return label.isNotNull() & vector.isNotNull() & F.coalesce(finite, F.lit(False))


def spanning_tree(points: np.ndarray) -> Tree:
    """Minimum spanning tree of the rows by Euclidean distance, from the row nearest to their
    mean (Prim's algorithm: a distance to every row for each row added)."""
    n = len(points)
    points = points.astype(float)
    root = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    nearest = np.full(n, root)
    dist = ((points - points[root]) ** 2).sum(axis=1)
    open_ = np.ones(n, bool)
    open_[root] = False
    depth = np.zeros(n, int)
    parent = np.full(n, -1)
    length = np.zeros(n)
    for _ in range(n - 1):
        v = int(np.where(open_, dist, np.inf).argmin())
        open_[v] = False
        parent[v], length[v] = nearest[v], np.sqrt(dist[v])
        depth[v] = depth[parent[v]] + 1
        own = ((points - points[v]) ** 2).sum(axis=1)
        closer = open_ & (own < dist)
        dist[closer], nearest[closer] = own[closer], v
    levels = [np.flatnonzero(depth == k) for k in range(1, int(depth.max(initial=0)) + 1)]
    return Tree(root, [(at, parent[at], length[at]) for at in levels])


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of integer rows."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if most < _EXACT:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def bounded_scores(tree, anchors, rows, low, high, allowed, found) -> int:
    """Walk a tree over a slice of candidates and report all exact scores inside the windows.

    ``low`` and ``high`` give each anchor's window; ``allowed(nodes)`` is a mask nodes x rows of
    the pairs asked for. ``found(node, positions, scores)`` may raise ``low``. Returns the number
    of pairs scored below the root.
    """
    norms = np.sqrt((rows.astype(float) ** 2).sum(axis=1)) * (1 + SAFE)
    n = len(rows)
    least = np.empty((len(anchors), n))
    most = np.empty((len(anchors), n))

    def report(node, scores, mask):
        at = np.flatnonzero(mask & (scores >= low[node]) & (scores <= high[node]))
        if len(at):
            found(node, at, scores[at])

    first = products(anchors[[tree.root]], rows)[0]
    least[tree.root] = most[tree.root] = first
    report(tree.root, first, allowed(np.array([tree.root]))[0])
    scored = 0
    for nodes, parents, lengths in tree.levels:
        reach = (lengths * (1 + SAFE))[:, None] * norms[None, :]
        below, above = least[parents] - reach, most[parents] + reach
        asked = allowed(nodes)
        inside = asked & (above >= low[nodes, None]) & (below <= high[nodes, None])
        # an interval that is one point is the score already
        open_ = inside & (below < above)
        scored += int(open_.sum())
        who, whom = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
        if len(who):
            exact = products(anchors[nodes[who]], rows[whom])
            below[np.ix_(who, whom)] = exact
            above[np.ix_(who, whom)] = exact
        least[nodes], most[nodes] = below, above
        for i in np.flatnonzero(inside.any(axis=1)):
            report(int(nodes[i]), below[i].astype(np.int64), inside[i] & (below[i] == above[i]))
    return scored


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as integer rows, filled up with zeros."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(len(sizes), width)
    matrix = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    matrix[row, place] = values
    return matrix


def _slices(batches: Iterator[pa.RecordBatch], width: int, anchors: int):
    """(ids, labels, vectors) of runs of rows that keep the intervals within ``CELLS``."""
    step = max(1, CELLS // max(1, anchors))
    for batch in batches:
        for at in range(0, batch.num_rows, step):
            part = batch.slice(at, step)
            ids, labels, vectors = part.columns
            yield ids.to_numpy(), labels.to_pylist(), _matrix(vectors, width)


def _positives(shared, width: int, k: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes, labels, anchors, trees = shared.value
        best = Best(len(own), k)
        low = np.full(len(own), -np.inf)
        high = np.full(len(own), np.inf)
        for ids, names, rows in _slices(batches, width, len(own)):
            code = np.array([codes.get(x, -1) for x in names], int)
            for label, tree in trees.items():
                at = np.flatnonzero(code == label)
                if not len(at):
                    continue
                near = ids[at]

                def found(node, places, scores, near=near):
                    worst = best.add(node, near[places], scores)
                    low[node] = -np.inf if worst is None else worst

                other = lambda nodes, near=near: own[nodes, None] != near[None, :]
                bounded_scores(tree, anchors, rows[at], low, high, other, found)
        anchor, found_ids, scores = best.rows()
        yield pa.RecordBatch.from_arrays(
            [pa.array(anchor.astype(np.int32)), pa.array(found_ids), pa.array(scores)],
            ["anchor", "id", "score"],
        )

    return search


def _negatives(shared, width: int, k: int, window: tuple[int, int]):
    share, whole = window

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, codes, labels, anchors, tree, positives = shared.value
        # lists are numbered through all positives of all anchors
        first = np.cumsum([0, *(len(p) for p in positives)])
        tops = [np.array([s for _, s in p], np.int64) for p in positives]
        floors = [-((-share * t) // whole) for t in tops]
        best = Best(int(first[-1]), k)
        low = np.array([f.min() if len(f) else np.inf for f in floors])
        high = np.array([t.max() if len(t) else -np.inf for t in tops])
        for ids, names, rows in _slices(batches, width, len(own)):
            code = np.array([codes.get(x, -1) for x in names], int)

            def found(node, places, scores, ids=ids):
                for j in range(len(tops[node])):
                    ok = (scores >= floors[node][j]) & (scores <= tops[node][j])
                    if ok.any():
                        worst = best.add(int(first[node]) + j, ids[places[ok]], scores[ok])
                        if worst is not None:
                            floors[node][j] = max(floors[node][j], worst)
                low[node] = floors[node].min()

            def other(nodes, code=code, ids=ids):
                asked = (labels[nodes, None] != code[None, :]) & (own[nodes, None] != ids[None, :])
                return asked & (low <= high)[nodes, None]

            bounded_scores(tree, anchors, rows, low, high, other, found)
        out = [
            (own[a], j, *positives[a][j], negative, score)
            for a in range(len(own))
            for j in range(len(positives[a]))
            for negative, score in zip(
                best.ids[first[a] + j], best.scores[first[a] + j], strict=True
            )
        ]
        columns = list(zip(*out, strict=True)) or [[]] * 6
        names = [
            "anchor_id", "place", "positive_id", "positive_score", "negative_id", "negative_score"
        ]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return search


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 5,
    window: tuple[int, int] = (80, 100),
    block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``window`` (80, 100) asks for 80 * positive score <= 100 * negative score <= 100 * positive
    score. Ids are integers; labels of any type are compared as text.
    """
    spark = vectors.sparkSession
    rows = written(
        vectors.filter(usable(F.col(label_col), F.col(vector_col)) & F.col(id_col).isNotNull())
        .select(
            F.col(id_col).cast("long").alias("id"),
            F.col(label_col).cast("string").alias("label"),
            integer_vector(F.col(vector_col), scale).alias("vector"),
            F.coalesce(is_anchor, F.lit(False)).alias("asks"),
        ),
        "vectors",
    )
    width = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    candidates = rows.select("id", "label", "vector")
    queries = rows.filter("asks").groupBy("id").agg(F.min(F.struct("label", "vector")).alias("_v"))
    queries = written(numbered(queries, [F.col("id")]), "anchors")
    folder = new_folder(spark, "hard_negatives")
    spark.createDataFrame([], RESULT).write.parquet(f"{folder}/none")
    for start in range(0, queries.count(), block):
        # ``block`` anchors at most
        here = queries.filter(F.col("number").between(start + 1, start + block))
        picked = here.orderBy("number").collect()
        own = np.array([r["id"] for r in picked], np.int64)
        names = sorted({r["_v"]["label"] for r in picked})
        codes = {name: i for i, name in enumerate(names)}
        labels = np.array([codes[r["_v"]["label"]] for r in picked])
        anchors = np.zeros((len(own), width), np.int64)
        for i, r in enumerate(picked):
            anchors[i, : len(r["_v"]["vector"])] = r["_v"]["vector"]
        trees = {}
        for label in range(len(names)):
            at = np.flatnonzero(labels == label)
            tree = spanning_tree(anchors[at])
            levels = [(at[n], at[p], length) for n, p, length in tree.levels]
            trees[label] = Tree(int(at[tree.root]), levels)
        shared = spark.sparkContext.broadcast((own, codes, labels, anchors, trees))
        nearest = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
        top = (
            candidates.mapInArrow(
                _positives(shared, width, positives), "anchor int, id long, score long"
            )
            .withColumn("place", F.row_number().over(nearest))
            .filter(F.col("place") <= positives)
            .orderBy("anchor", "place")
            .collect()  # positives * block rows at most
        )
        lists: list[list[tuple[int, int]]] = [[] for _ in own]
        for r in top:
            lists[r["anchor"]].append((r["id"], r["score"]))
        shared2 = spark.sparkContext.broadcast(
            (own, codes, labels, anchors, spanning_tree(anchors), lists)
        )
        ranked = Window.partitionBy("anchor_id", "place").orderBy(
            F.desc("negative_score"), "negative_id"
        )
        mined = candidates.mapInArrow(
            _negatives(shared2, width, negatives, window),
            "anchor_id long, place long, positive_id long, positive_score long, "
            "negative_id long, negative_score long",
        )
        mined.withColumn("rank", F.row_number().over(ranked)).filter(
            F.col("rank") <= negatives
        ).select(*[c.split()[0] for c in RESULT.split(", ")]).write.parquet(f"{folder}/{start}")
    reader = spark.read.schema(RESULT).option("recursiveFileLookup", True)
    return reader.parquet(folder)
