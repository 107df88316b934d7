"""Hard negatives against all pairs, and the bounds along the tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexmill.llm import hard_negatives
from lexmill.llm.hard_negatives import bounded_scores, mine_hard_negatives, spanning_tree


def brute(rows, anchors, positives=5, negatives=5):
    """(anchor, positive, rank, negative, scores) by all pairs."""
    part = []
    for i, label, v in rows:
        if i is not None and label is not None and v is not None and all(
            x is not None and np.isfinite(x) for x in v
        ):
            part.append((i, str(label), [int(np.floor(256.0 * x)) for x in v]))
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    out = []
    for a in anchors:
        own = sorted((label, v) for i, label, v in part if i == a)
        if not own:
            continue
        label, v = own[0]
        ranked = sorted((-score(v, w), i, other) for i, other, w in part if i != a)
        for s, i in [(-s, i) for s, i, other in ranked if other == label][:positives]:
            inside = [(-t, j) for t, j, other in ranked if other != label and 80 * s <= -100 * t <= 100 * s]
            out += [(a, i, k, j, s, t) for k, (t, j) in enumerate(inside[:negatives], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(12, 8)) / 3
    rows = []
    for i in range(150):
        v = base[i % 12] + rng.normal(size=8) * (0.02 if i % 3 else 0)
        rows.append((i, i % 5, [float(x) for x in v]))
    rows += [(200, None, rows[0][2]), (201, 1, None), (202, 1, [1.0, None]), (203, 2, [float("nan")] * 8),
             (204, 2, [float("inf")] * 8), (None, 1, rows[3][2]), (205, 1, []), (206, 1, rows[5][2][:3]),
             (207, 3, [0.0] * 8), (10, 2, rows[10][2]), (50, 2, rows[50][2]), (51, 3, rows[51][2])]
    return rows


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_all_pairs(spark, rows, block):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").selectExpr(
        "*", "'x' AS vector", "1 AS anchor", "'y' AS score"
    )
    got = mine_hard_negatives(df.repartition(3), F.col("vec_id") % 10 == 0, block=block)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    expected = brute(rows, [i for i in range(0, 210, 10)])
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 100


def test_no_rows(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    assert mine_hard_negatives(df, F.lit(False)).count() == 0
    assert mine_hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    assert mine_hard_negatives(df.limit(0), F.lit(True)).count() == 0
    # one label has no negatives, one row no positives
    assert mine_hard_negatives(df.filter("label = 1"), F.lit(True)).count() == 0
    assert mine_hard_negatives(df.filter("vec_id = 7"), F.lit(True)).count() == 0


def test_tree_spans_and_bounds_hold():
    rng = np.random.default_rng(2)
    centres = rng.integers(-60, 60, (5, 6))
    points = (centres[rng.integers(0, 5, 40)] + rng.integers(-1, 2, (40, 6))).astype(np.int64)
    tree = spanning_tree(points)
    seen = {tree.root}
    for nodes, parents, lengths in tree.levels:
        assert set(parents) <= seen and not seen & set(nodes)
        seen |= set(nodes.tolist())
        assert lengths == pytest.approx(np.linalg.norm(points[nodes] - points[parents], axis=1))
    assert seen == set(range(40))
    # total length is the least
    order = [(np.linalg.norm(a - b), i, j) for i, a in enumerate(points) for j, b in enumerate(points) if i < j]
    group, total = list(range(40)), 0.0
    for d, i, j in sorted(order):
        if group[i] != group[j]:
            total, old = total + d, group[j]
            group = [group[i] if g == old else g for g in group]
    assert sum(x[2].sum() for x in tree.levels) == pytest.approx(total)
    candidates = (centres[rng.integers(0, 5, 300)] + rng.integers(-2, 3, (300, 6))).astype(np.int64)
    exact = points @ candidates.T
    low, high = np.quantile(exact, 0.9, axis=1), np.full(40, np.inf)
    found = {}

    def keep(node, at, scores):
        found[node] = dict(zip(at.tolist(), scores.tolist(), strict=True))

    every = lambda nodes: np.ones((len(nodes), 300), bool)
    scored = bounded_scores(tree, points, candidates, low, high, every, keep)
    for node in range(40):
        inside = np.flatnonzero(exact[node] >= low[node])
        assert found.get(node, {}) == {int(i): int(exact[node, i]) for i in inside}
    # near anchors share most of their scores
    assert scored < 0.6 * exact.size


def test_large_components_stay_exact():
    a = np.array([[2**30, 2**30 + 1]])
    assert hard_negatives.products(a, a)[0, 0] == 2**60 + (2**30 + 1) ** 2
