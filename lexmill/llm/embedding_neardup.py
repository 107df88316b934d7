"""Near duplicates among embeddings of one label, by NN-descent.

Equal vectors are merged first. Every vector starts with neighbours from sorted random
projections and then meets, round by round, the neighbours of its neighbours, in both
directions; the nearest ``k`` stay. Rounds end when few lists change. A list whose last
entry still reaches the threshold is saturated: it is enlarged to all of the vector's
component, cut into blocks whose pairs are multiplied out in numpy, so that no pair is ever
a row; blocks that lie close to or far from each other by the triangle inequality are
counted whole. Links between saturated vectors may be in no list, so the blocks of all
components with a saturated list meet within their label, and components that turn out to be
linked are merged. Recall is audited against all rows for a sample of vectors.

Links are exact cosines in double precision. Vectors that are null, empty, zero or hold a
null or non-finite component, and rows without label, link with nothing.

Defined cases: null ids are kept and named null; repeated rows are vectors of their own that
link with each other; vectors of unlike length never link; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.llm.byte_words import mix64
from lexmill.llm.components import connected_components
from lexmill.llm.mixing import running_totals
from lexmill.session import written

NEIGHBOURS = 10
# neighbours of each direction that are joined in a round
SAMPLE = 6
ROUNDS = 6
# lost pairs that the sign-code orders may leave to the rounds
SEED_MISS = 0.001
ORDER_NEAR = 5
BLOCK = 256
# centres of blocks that are compared at once, about
CENTRES = 512
AUDIT_ROWS = 1024
AUDIT_RECALL = 0.98
MOST_ATTEMPTS = 4

_EDGES = "u long, v long, s double"


def _edge_batch(u, v, s) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.asarray(u, np.int64)), pa.array(np.asarray(v, np.int64)),
         pa.array(np.asarray(s, np.float64))],
        ["u", "v", "s"],
    )


def _unit(blobs, dim: int) -> np.ndarray:
    """Unit vectors in double precision from the stored 4- or 8-byte components."""
    blobs = [b.as_buffer() for b in blobs]
    kind = np.float32 if blobs[0].size == 4 * dim else np.float64
    rows = np.frombuffer(b"".join(blobs), kind).reshape(len(blobs), dim).astype(np.float64)
    # the largest component first, so that no square overflows or vanishes
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no infinite or NaN component, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _packed_vectors(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, dim, blob`` of usable rows, the vector as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            values, offsets = column.values.to_numpy(), column.offsets.to_numpy()
            blobs = [values[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            dims = np.diff(offsets).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(dims), pa.array(blobs, pa.binary())],
                ["vec_id", "label", "dim", "blob"],
            )

    ready = vectors.filter(F.col("label").isNotNull() & usable(F.col("embedding")))
    label = ready.schema["label"].dataType.simpleString()
    return ready.mapInArrow(run, f"vec_id long, label {label}, dim int, blob binary")


def projections(rows: int, threshold: float, miss: float = SEED_MISS, near: int = ORDER_NEAR) -> int:
    """Sign-code orders after which a pair at the threshold has met but for ``miss``.

    ``rows``: of the largest label. In one order a pair meets if its codes agree in the bits
    that about ``near`` rows share; a bit differs with probability angle / pi.
    """
    agree = 1 - float(np.arccos(threshold)) / np.pi
    meets = agree ** max(1.0, np.log2(max(rows, 2) / near) + 1)
    return max(4, int(np.ceil(np.log(miss) / np.log1p(-min(meets, 1 - 1e-9)))))


def _projected(nodes: DataFrame, tables: range, bits: int, near: int = ORDER_NEAR) -> DataFrame:
    """Edges between vectors that are close in one of the orders of their sign codes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            parts = []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                parts.append((int(dim), at, _unit(batch.column(3).take(pa.array(at)), int(dim))))
            for table in tables:
                codes = np.zeros(batch.num_rows, np.int64)
                for dim, at, units in parts:
                    if (table, dim) not in planes:
                        draw = np.random.Generator(np.random.PCG64([table, dim]))
                        planes[table, dim] = draw.normal(size=(dim, bits))
                    codes[at] = (units @ planes[table, dim] > 0) @ (1 << np.arange(bits, dtype=np.int64))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(codes), pa.array(np.full(batch.num_rows, table, np.int32))],
                    ["node", "cell", "dim", "blob", "code", "table"],
                )

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if tail is None else [tail, batch])
            rows = rows.combine_chunks()
            node, cell, table = (rows[c].to_numpy() for c in ("node", "cell", "table"))
            dims = rows["dim"].to_numpy()
            us, vs, ss = [], [], []
            for dim in np.unique(dims):
                at = np.flatnonzero(dims == dim)
                units = _unit(rows["blob"].combine_chunks().take(pa.array(at)), int(dim))
                for k in range(1, near + 1):
                    a, b = at[:-k], at[k:]
                    same = (cell[a] == cell[b]) & (table[a] == table[b])
                    s = (units[:-k] * units[k:]).sum(1)[same]
                    us += [node[a][same], node[b][same]]
                    vs += [node[b][same], node[a][same]]
                    ss += [s, s]
            if us:
                yield _edge_batch(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))
            last = rows.slice(max(0, rows.num_rows - near)).combine_chunks().to_batches()
            tail = last[0] if last else None

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    coded = nodes.select("node", "cell", "dim", "blob").mapInArrow(
        code, "node long, cell long, dim int, blob binary, code long, table int"
    )
    order = ["table", "cell", "code", "node"]
    return coded.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(pair, _EDGES)


def _nearest(edges: DataFrame, k: int) -> DataFrame:
    best = edges.groupBy("u", "v").agg(F.max("s").alias("s"))
    by = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return best.withColumn("_r", F.row_number().over(by)).filter(F.col("_r") <= k).drop("_r")


def _met(lists: DataFrame, nodes: DataFrame, k: int, sample: int) -> DataFrame:
    """Edges that neighbours of one vector form among themselves and that improve a list."""
    worst = lists.groupBy("u").agg(
        F.when(F.count(F.lit(1)) >= k, F.min("s")).otherwise(-2.0).alias("worst")
    )
    out = Window.partitionBy("m").orderBy(F.desc("s"), "x")
    ways = [
        lists.select(F.col(m).alias("m"), F.col(x).alias("x"), "s")
        .withColumn("_r", F.row_number().over(out))
        .filter(F.col("_r") <= sample)
        .select("m", "x")
        for m, x in (("u", "v"), ("v", "u"))
    ]
    own = lists.select(F.col("u").alias("m"), F.col("u").alias("x")).distinct()
    around = ways[0].union(ways[1]).union(own).distinct()
    carried = nodes.join(worst, F.col("node") == F.col("u"), "left").select(
        F.col("node").alias("x"), F.coalesce("worst", F.lit(-2.0)).alias("worst"), "dim", "blob"
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = None
        for batch in batches:
            rows = pa.Table.from_batches([batch] if tail is None else [tail, batch]).combine_chunks()
            m = rows["m"].to_numpy()
            # the last group may go on in the next batch; a group has 2 * sample + 1 rows at most
            cut = int(np.searchsorted(m, m[-1]))
            yield from _meet(rows.slice(0, cut))
            rest = rows.slice(cut).combine_chunks().to_batches()
            tail = rest[0]
        if tail is not None:
            yield from _meet(pa.Table.from_batches([tail]))

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        around.join(carried, "x")
        .select("m", "x", "worst", "dim", "blob")
        .repartition(n, "m")
        .sortWithinPartitions("m", "x")
        .mapInArrow(meet, _EDGES)
    )


def _meet(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    if not rows.num_rows:
        return
    m, x, worst = (rows[c].to_numpy() for c in ("m", "x", "worst"))
    blobs = rows["blob"].combine_chunks()
    units = _unit(blobs, rows["dim"][0].as_py()) if len(rows["dim"].unique()) == 1 else None
    us, vs, ss = [], [], []
    cuts = [0, *(np.flatnonzero(np.diff(m)) + 1), len(m)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a < 2:
            continue
        part = units[a:b] if units is not None else _unit(blobs[a:b], rows["dim"][int(a)].as_py())
        s = part @ part.T
        np.fill_diagonal(s, -3)
        i, j = np.nonzero(s > worst[a:b, None])
        us.append(x[a:b][i])
        vs.append(x[a:b][j])
        ss.append(s[i, j])
    if us:
        yield _edge_batch(np.concatenate(us), np.concatenate(vs), np.concatenate(ss))


def _sides(one: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of block ids, turned by a hash: a block is on each side of half of its pairs, so
    that no block, and no component, brings all its pairs to one task."""
    turn = mix64((one ^ other).astype(np.uint64) + mix64((one + other).astype(np.uint64))) & np.uint64(1)
    return np.where(turn, other, one), np.where(turn, one, other)


def _dense_counts(members: DataFrame, threshold: float, block: int) -> tuple[DataFrame, DataFrame]:
    """``node, linked`` (rows linked, its own copies and itself included) among all members of
    a cell, and ``u, v``, components that a link joins.

    ``members``: ``component, cell, node, mult, dim, blob``. A component is cut into blocks in
    the order of the angle to its first vector. Two blocks of a cell can only hold a link if
    their centres are no further apart than their radii and the threshold's angle together;
    those are multiplied out. Only a block and the counts of its vectors are ever rows.
    """
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pivots = members.filter("node = component").select("component", F.col("blob").alias("pivot"))

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(4).to_numpy()
            out = np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                at = pa.array(np.flatnonzero(dims == dim))
                a, b = (_unit(batch.column(c).take(at), int(dim)) for c in (5, 6))
                out[at.to_numpy()] = np.arccos(np.clip((a * b).sum(1), -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:6], pa.array(out), pa.array(np.ones(batch.num_rows, np.int64))],
                ["component", "cell", "node", "mult", "dim", "blob", "angle", "one"],
            )

    placed = members.join(pivots, "component").select(
        "component", "cell", "node", "mult", "dim", "blob", "pivot"
    )
    placed = placed.mapInArrow(
        angles,
        "component long, cell long, node long, mult long, dim int, blob binary, angle double, one long",
    )
    order = [F.col("component"), F.col("angle"), F.col("node")]
    numbered = written(running_totals(placed, order, {"number": "one"}), "numbered")
    starts = numbered.groupBy("component").agg(F.min("number").alias("start"))
    blocks = (
        numbered.join(starts, "component")
        .withColumn("block", F.floor((F.col("number") - F.col("start")) / block))
        .groupBy("component", "block")
        .agg(
            F.min("number").alias("id"),
            F.first("cell").alias("cell"),
            F.collect_list(F.struct("node", "mult", "dim", "blob")).alias("rows"),
        )
    )
    # ``block`` rows at most
    blocks = written(blocks.select("id", "component", "cell", "rows"), "blocks")

    def centre(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            centres, radii = [], []
            for rows in batch.column(2):
                rows = pa.RecordBatch.from_struct_array(rows.values)
                units = _unit(rows.column(3), rows.column(2)[0].as_py())
                middle = units.mean(axis=0)
                length = np.sqrt(middle @ middle)
                middle = middle / length if length > 1e-9 else units[0]
                centres.append(middle.tobytes())
                radii.append(float(np.arccos(np.clip(units @ middle, -1, 1)).max()))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(centres, pa.binary()), pa.array(radii, pa.float64())],
                ["id", "cell", "centre", "radius"],
            )

    centres = written(
        blocks.select("id", "cell", "rows").mapInArrow(
            centre, "id long, cell long, centre binary, radius double"
        ),
        "centres",
    )
    sizes = centres.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / CENTRES).alias("m"))
    chunks = written(
        centres.join(sizes, "cell")
        .withColumn("chunk", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("m")))
        .groupBy("cell", "chunk")
        .agg(F.collect_list(F.struct("id", "centre", "radius")).alias("them")),
        "chunks",
    )
    each = sizes.select("cell", "m", F.explode(F.sequence(F.lit(0), F.col("m") - 1)).alias("i"))
    each = each.select("cell", "i", F.explode(F.sequence("i", F.col("m") - 1)).alias("j"))
    chunk_pairs = (
        each.repartition(n, "cell", "i", "j")
        .join(chunks.select("cell", F.col("chunk").alias("i"), F.col("them").alias("a")), ["cell", "i"])
        .join(chunks.select("cell", F.col("chunk").alias("j"), F.col("them").alias("b")), ["cell", "j"])
        .select((F.col("i") == F.col("j")).alias("same"), "a", "b")
    )
    reach = float(np.arccos(threshold))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (pa.RecordBatch.from_struct_array(batch.column(c)[k].values) for c in (1, 2))
                u, v = (
                    np.frombuffer(b"".join(x.column(1).to_pylist())).reshape(x.num_rows, -1)
                    for x in (a, b)
                )
                apart = np.arccos(np.clip(u @ v.T, -1, 1))
                radii = a.column(2).to_numpy()[:, None] + b.column(2).to_numpy()
                ok = apart <= radii + reach + 1e-6
                one, other = a.column(0).to_numpy(), b.column(0).to_numpy()
                if batch.column(0)[k].as_py():
                    ok &= one[:, None] <= other
                i, j = np.nonzero(ok)
                left, right = _sides(one[i], other[j])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(left), pa.array(right),
                     pa.array((apart + radii)[i, j] <= reach - 1e-6)],
                    ["i", "j", "whole"],
                )

    pairs = written(chunk_pairs.mapInArrow(near, "i long, j long, whole boolean"), "pairs")
    pairs = pairs.join(
        blocks.select(F.col("id").alias("i"), F.col("component").alias("u"), F.col("rows").alias("a")), "i"
    ).join(
        blocks.select(F.col("id").alias("j"), F.col("component").alias("v"), F.col("rows").alias("b")), "j"
    )

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                same, whole, u, v = (batch.column(c)[k].as_py() for c in range(4))
                a, b = (pa.RecordBatch.from_struct_array(batch.column(c)[k].values) for c in (4, 5))
                one, other = a.column(1).to_numpy(), b.column(1).to_numpy()
                if whole:
                    s = np.ones((len(one), len(other)), bool)
                else:
                    dim = a.column(2)[0].as_py()
                    s = _unit(a.column(3), dim) @ _unit(b.column(3), dim).T >= threshold
                if same:
                    np.fill_diagonal(s, True)
                nodes, counts = [a.column(0).to_numpy()], [s @ other]
                if not same:
                    nodes.append(b.column(0).to_numpy())
                    counts.append(one @ s)
                joins = [None] * (len(one) + (0 if same else len(other)))
                if u != v and s.any():
                    nodes.append([u])
                    counts.append([0])
                    joins.append(v)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(nodes).astype(np.int64)),
                     pa.array(np.concatenate(counts).astype(np.int64)), pa.array(joins, pa.int64())],
                    ["node", "linked", "other"],
                )

    counted = pairs.select((F.col("i") == F.col("j")).alias("same"), "whole", "u", "v", "a", "b")
    counted = written(counted.mapInArrow(multiply, "node long, linked long, other long"), "counted")
    linked = counted.filter("other IS NULL").groupBy("node").agg(F.sum("linked").alias("linked"))
    joins = counted.filter("other IS NOT NULL").select(F.col("node").alias("u"), F.col("other").alias("v"))
    return linked, joins.distinct()


def audit_recall(
    nodes: DataFrame,
    counts: DataFrame,
    threshold: float,
    rows: int = AUDIT_ROWS,
    few: int = NEIGHBOURS,
) -> float:
    """Mean share of a vector's true links that were found, over about ``rows`` vectors, chosen
    by a hash, that have links other than their own copies. Vectors of up to ``few`` links and
    the others are judged apart, and the lower mean counts.

    The chosen vectors go to the executors and meet all others there in blocks.
    """
    n = nodes.count()
    share = min(1.0, rows / max(n, 1))
    asked = nodes.filter(F.pmod(F.xxhash64(F.lit(3), "node"), F.lit(1 << 30)) < int(share * (1 << 30)))
    asked = asked.select("node", "cell", "mult", "dim", "blob").toArrow()
    if not asked.num_rows:
        return 1.0
    shared = nodes.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        them = shared.value
        node, cell = them["node"].to_numpy(), them["cell"].to_numpy()
        for batch in batches:
            for c in np.intersect1d(cell, batch.column(1).to_numpy()):
                at, mine = (np.flatnonzero(x == c) for x in (cell, batch.column(1).to_numpy()))
                dim = batch.column(3)[int(mine[0])].as_py()
                a = _unit(them["blob"].combine_chunks().take(pa.array(at)), dim)
                b = _unit(batch.column(4).take(pa.array(mine)), dim)
                linked = (a @ b.T >= threshold) @ batch.column(2).to_numpy()[mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(node[at]), pa.array(linked.astype(np.int64))], ["node", "linked"]
                )

    truth = (
        nodes.select("node", "cell", "mult", "dim", "blob")
        .mapInArrow(run, "node long, linked long")
        .groupBy("node")
        .agg((F.sum("linked") - 1).alias("true_links"))
    )
    copies = F.col("mult") - 1
    got = (
        truth.join(counts, "node")
        .join(nodes.select("node", "mult"), "node")
        .select((F.col("true_links") - copies).alias("wanted"), (F.col("n_links") - copies).alias("got"))
        .filter("wanted > 0")
        .groupBy((F.col("wanted") <= few).alias("few"))
        .agg(F.avg(F.least("got", "wanted") / F.col("wanted")).alias("share"))
    )
    return min((r["share"] for r in got.collect()), default=1.0)


def embedding_classes(
    vectors: DataFrame,
    threshold: float = 0.98,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    label: str = "label",
    k: int = NEIGHBOURS,
    sample: int = SAMPLE,
    rounds: int = ROUNDS,
    tables: int | None = None,
    block: int = BLOCK,
    recall: float = AUDIT_RECALL,
) -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    ``tables``: orders to start from; None lets them follow from the rows of the largest label.
    While the audit finds less than ``recall`` of the links, further projections and rounds
    follow, ``MOST_ATTEMPTS`` times at most; after that it is an error.
    """
    vectors = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        F.col(label).alias("label"),
        F.col(embedding).alias("embedding"),
    )
    packed = _packed_vectors(vectors).select(
        "vec_id",
        F.xxhash64("label", "dim", "blob").alias("node"),
        F.xxhash64("label", "dim").alias("cell"),
        "dim",
        "blob",
    )
    packed = written(packed, "packed")
    nodes = written(
        packed.groupBy("node").agg(
            F.first("cell").alias("cell"), F.count(F.lit(1)).alias("mult"), F.first("dim").alias("dim"),
            F.first("blob").alias("blob"), F.min("vec_id").alias("first_id"),
        ),
        "nodes",
    )
    n = nodes.count()
    bits = int(min(max(n.bit_length() - 2, 6), 30))
    if tables is None:
        largest = nodes.groupBy("cell").count().agg(F.max("count").alias("rows")).first()["rows"]
        tables = projections(largest or 0, threshold)
    lists = None
    for attempt in range(MOST_ATTEMPTS):
        edges = _projected(nodes, range(attempt * tables, (attempt + 1) * tables), bits)
        lists = written(_nearest(edges if lists is None else lists.union(edges), k), "lists")
        linked = lists.filter(F.col("s") >= threshold).count()
        for _ in range(rounds):
            lists = written(_nearest(lists.union(_met(lists, nodes, k, sample)), k), "lists")
            before, linked = linked, lists.filter(F.col("s") >= threshold).count()
            if linked == before:
                break
        counts, components = _counted(lists, nodes, threshold, k, block)
        found = audit_recall(nodes, counts, threshold)
        if found >= recall:
            break
    else:
        raise RuntimeError(f"only {found:.4f} of the audited links after {MOST_ATTEMPTS} attempts")
    firsts = (
        nodes.join(components, "node", "left")
        .withColumn("component", F.coalesce("component", "node"))
        .select("node", "component", "first_id")
    )
    least = firsts.groupBy("component").agg(F.min("first_id").alias("component_id"))
    found = counts.join(firsts.join(least, "component"), "node").select(
        "node", "n_links", "component_id"
    )
    found = packed.select("vec_id", "node").join(written(found, "found"), "node").drop("node")
    others = vectors.filter(F.col("label").isNull() | ~usable(F.col("embedding"))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    return found.union(others).select(
        "vec_id", "n_links", "component_id",
        F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"),
    )


def _counted(lists: DataFrame, nodes: DataFrame, threshold: float, k: int, block: int):
    """``node, n_links`` of every node, and ``node, component`` of the linked ones."""
    links = lists.filter(F.col("s") >= threshold)
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = written(both.distinct(), "links")
    components = written(connected_components(both, "u", "v"), "components")
    saturated = links.groupBy("u").count().filter(F.col("count") >= k).select(F.col("u").alias("node"))
    dense = components.join(saturated, "node", "left_semi").select("component").distinct()
    inside = components.join(dense, "component", "left_semi").join(nodes, "node")
    dense_counts, joins = _dense_counts(
        inside.select("component", "cell", "node", "mult", "dim", "blob"), threshold, block
    )
    dense_counts = written(dense_counts, "dense")
    if not joins.isEmpty():
        merged = connected_components(joins, "u", "v").select(
            F.col("node").alias("component"), F.col("component").alias("merged")
        )
        components = components.join(merged, "component", "left").select(
            "node", F.coalesce("merged", "component").alias("component")
        )
        components = written(components, "components")
    near = (
        both.join(nodes.select(F.col("node").alias("v"), "mult"), "v")
        .groupBy(F.col("u").alias("node"))
        .agg(F.sum("mult").alias("near"))
    )
    counts = (
        nodes.select("node", "mult")
        .join(near, "node", "left")
        .join(dense_counts, "node", "left")
        .select(
            "node",
            F.coalesce(
                F.col("linked") - 1, F.col("mult") - 1 + F.coalesce("near", F.lit(0))
            ).alias("n_links"),
        )
    )
    return written(counts, "counts"), components
