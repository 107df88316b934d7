"""Lexical search against plain scores of all documents."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from lexmill.llm import lexical_search
from lexmill.llm.lexical_search import search_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, k):
    terms = [(i, TERM.findall((t or "").translate(LOWER))) for i, t in docs]
    terms = [(i, w) for i, w in terms if w]
    n, total = len(terms), sum(len(w) for _, w in terms)
    df = Counter(t for _, w in terms for t in set(w))
    out = []
    for item, text in items:
        asked = TERM.findall((text or "").translate(LOWER))
        scores = []
        for i, w in terms:
            tf, m = Counter(w), 75 + (25 * len(w) * n) // total
            score = sum(
                math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1)))
                * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in asked
                if tf[t]
            )
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(120)]
    share = 1 / np.arange(1, 121)
    share /= share.sum()
    docs = [(i, " ".join(rng.choice(words, int(rng.integers(1, 60)), p=share))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(30)]  # ties
    docs += [(7, docs[7][1]), (None, "w3 w50 w90"), (600, None), (601, ""), (602, "... !!"),
             (603, "É W3 w3É w３ é"), (604, " ".join(words * 60)), (605, "W50-w50_w50/w51")]
    items = [(i, " ".join(rng.choice(words, 9))) for i in range(25)]
    items += [(3, "w3 w3 w3 W50"), (None, "w1 w99"), (90, None), (91, "!"), (92, "unseen"), (93, "É é w３")]
    return docs, items


@pytest.mark.parametrize("block", [4096, 7])
def test_equals_plain_scores(spark, tables, monkeypatch, block):
    docs, items = tables
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 50)
    monkeypatch.setattr(lexical_search, "LEAF", 4)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'c' AS codes")
    q = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS number", "2 AS rank")
    got = search_documents(d.repartition(3), q, k=6, item_block=block).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items, 6)


def test_no_rows(spark, tables):
    docs, items = tables
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert search_documents(d.limit(0), q).count() == 0
    assert search_documents(d, q.limit(0)).count() == 0
    assert search_documents(d.filter("text is null"), q).count() == 0


def test_bounds_hold_and_prune():
    """No node's bound is below a score in it, and copies of a passage are found early."""
    rng = np.random.default_rng(3)
    docs, width = 512, 300
    sizes = rng.integers(1, 30, docs)
    codes = [np.sort(rng.choice(width, n, replace=False)) for n in sizes]
    for i in range(40):  # copies
        codes[i * 12] = np.arange(40, 52)
    order = sorted(range(docs), key=lambda i: tuple(codes[i]))
    codes = [codes[i] for i in order]
    sizes = np.array([len(c) for c in codes])
    flat = np.concatenate(codes)
    values = rng.integers(1, 1_000_000, len(flat))
    weights = rng.integers(-400, 7000, width)
    scores = values * weights[flat]
    tree_order, nodes = lexical_search.ball_tree(lexical_search.Rows(sizes, flat, scores.astype(float)), width, 8)
    kept = lexical_search.Rows(sizes, flat, values).take(tree_order)
    first, last, left, radius = (np.array(x) for x in zip(*nodes, strict=True))
    offsets = np.array([0, 12, 20])
    queries = lexical_search.Queries(
        offsets, np.concatenate([np.arange(40, 52), rng.choice(width, 8, replace=False)]),
        np.array([1] * 12 + [2] * 8), weights,
    )
    row = {"block": "0-1", "ids": np.arange(docs), "sizes": kept.sizes, "codes": kept.codes,
           "values": kept.values, "first": first, "last": last, "left": left, "radius": radius}
    block = lexical_search.Block(row, queries)
    block._tables()
    for q in (0, 1):
        dense = np.zeros(width)
        part = slice(offsets[q], offsets[q + 1])
        dense[queries.codes[part]] = queries.counts[part]
        exact = np.add.reduceat(dense[kept.codes] * kept.values * weights[kept.codes], kept.starts)
        assert block.root_bounds()[q] >= exact.max()
        for a, b, _, r in nodes:
            own = kept.take(np.arange(a, b))
            vectors = np.zeros((b - a, width))
            vectors[np.repeat(np.arange(b - a), own.sizes), own.codes] = own.values * weights[own.codes]
            assert r >= np.linalg.norm(vectors - vectors.mean(0), axis=1).max() * (1 - 1e-9)
        best = lexical_search.Best(2, 20)
        _, scored = block.search(q, best, 1)
        top = sorted(((-int(s), i) for i, s in enumerate(exact) if s >= 1))[:20]
        assert list(zip(best.scores[q].tolist(), best.ids[q].tolist(), strict=True)) == [(-s, i) for s, i in top]
        if q == 0:
            assert scored < docs / 2
