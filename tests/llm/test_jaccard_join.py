import random

import numpy as np
import pytest

from lexmill.llm import jaccard_join
from lexmill.llm.components import connected_components
from lexmill.llm.jaccard_join import first_of_each_class, jaccard_classes, signatures
from tests.llm.test_byte_words import plain_words


def brute(rows, size, num, den):
    """Smallest reachable id per row, by comparing all pairs."""
    sets = []
    for _, text in rows:
        w = plain_words(text)
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and den * len(a & b) >= num * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return [(k, len(s), least.get(find(i), k)) for i, ((k, _), s) in enumerate(zip(rows, sets, strict=True))]


def corpus(seed, families=6, copies=25, length=60):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = draw.choices(vocabulary, k=30)
    rows = []
    for _ in range(families):
        base = draw.choices(vocabulary, k=draw.randint(8, length))
        if draw.random() < 0.5:
            base[2:2] = shared
        for _ in range(copies):
            words = list(base)
            for _ in range(draw.choice([0, 0, 1, 1, 2, 3])):
                at = draw.randrange(len(words))
                action = draw.random()
                if action < 0.5:
                    words[at] = draw.choice(vocabulary)
                elif action < 0.75:
                    words.insert(at, draw.choice(vocabulary))
                elif len(words) > 1:
                    del words[at]
            rows.append(" ".join(words))
    rows += ["", None, " \n\t", "one", "One", "two words", "two words", "x"]
    draw.shuffle(rows)
    ids = list(range(100, 100 + len(rows)))
    draw.shuffle(ids)
    return list(zip(ids, rows, strict=True))


@pytest.mark.parametrize(
    ("seed", "size", "num", "den", "rare"),
    [(1, 3, 9, 10, 8), (2, 5, 4, 5, 8), (3, 2, 3, 4, 3), (4, 1, 1, 2, 2), (5, 3, 9, 10, 2)],
)
def test_equals_all_pairs(spark, monkeypatch, seed, size, num, den, rare):
    # low limits bring pairs and triples of shingles into play
    monkeypatch.setattr(jaccard_join, "RARE_BELOW", rare)
    monkeypatch.setattr(jaccard_join, "TRIPLES_FROM", 3)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_classes(df, size, (num, den)).drop("text_key").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, size, num, den))


@pytest.mark.parametrize(("seed", "size", "num", "den"), [(1, 3, 9, 10), (6, 2, 4, 5), (4, 1, 1, 2)])
def test_sets_around_centres_equal_all_pairs(spark, monkeypatch, seed, size, num, den):
    # all signatures of more than two sets get centres
    for name, value in (("RARE_BELOW", 3), ("TRIPLES_FROM", 3), ("PAIRED", 1), ("CENTRES", 2)):
        monkeypatch.setattr(jaccard_join, name, value)
    # some copies of copies, so that sets far from a centre share differences
    rows = corpus(seed, families=4, copies=15)
    draw = random.Random(seed)
    texts = [t.split() for _, t in rows if t and len(t.split()) > 7]
    for k in range(30):
        words = list(draw.choice(texts))
        for _ in range(draw.choice([1, 4, 6])):
            words[draw.randrange(len(words))] = f"own{draw.randrange(40)}"
        rows.append((1000 + k, " ".join(words)))
        texts.append(words)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = jaccard_classes(df, size, (num, den)).drop("text_key").collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, size, num, den))


def test_unconnected_copies_are_not_paired(spark):
    """Copies too far apart to link lie around one text; they must not meet one by one."""
    draw = random.Random(8)
    fresh = lambda k: {draw.getrandbits(63) for _ in range(k)}
    changed = lambda s, k: set(draw.sample(sorted(s), len(s) - k)) | fresh(k)
    base = fresh(200)
    # beside the centre those that link with it, those that don't, and near copies of either
    found = [base] + [changed(base, 4) for _ in range(30)] + [changed(base, 15) for _ in range(90)]
    found += [changed(draw.choice(found[1:]), k) for k in (2, 5, 8, 10) * 8]
    linked = {
        (i, j) for j in range(len(found)) for i in range(j)
        if 10 * len(found[i] & found[j]) >= 9 * len(found[i] | found[j])
    }
    sets = spark.createDataFrame(
        [(i, bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in enumerate(found)],
        "node long, shingles binary",
    )
    spokes = spark.createDataFrame([(0, i) for i in range(1, len(found))], "a long, b long")
    around = jaccard_join._differences(spokes, sets, 9, 10)
    inside = {r.b for r in around.collect() if r.excess <= 0}
    assert inside == {j for i, j in linked if i == 0}
    alone = spark.createDataFrame([], "b long, b_of long")
    pairs = [tuple(r) for r in jaccard_join._around_pairs(around, alone, 9, 10).collect()]
    wanted = {(i, j) for i, j in linked if i and not (i in inside and j in inside)}
    assert len(wanted) > 10 and wanted <= set(pairs)
    # 11,476 pairs in all
    assert len(pairs) < 3 * len(wanted), (len(pairs), len(wanted))


def test_linked_sets_share_a_signature():
    draw = np.random.Generator(np.random.PCG64(3))
    for num, den in ((9, 10), (4, 5), (1, 2)):
        for _ in range(300):
            n = int(draw.integers(1, 200))
            both = draw.integers(1, 2**63, n).astype(np.uint64)
            extra = draw.integers(0, n * (den - num) // num + 2)
            other = np.concatenate([both, draw.integers(1, 2**63, extra).astype(np.uint64)])
            lost = draw.integers(0, n * (den - num) // den + 2)
            other = other[lost:]
            a, b = np.unique(both), np.unique(other)
            overlap = len(np.intersect1d(a, b))
            if not overlap or den * overlap < num * (len(a) + len(b) - overlap) or np.array_equal(a, b):
                continue
            levels = lambda x: (x % np.uint64(8)).astype(np.uint8)
            sa, _ = signatures(a, levels(a), num, den)
            sb, _ = signatures(b, levels(b), num, den)
            assert len(np.intersect1d(sa, sb)), (n, len(b), num, den)


def test_odd_rows(spark):
    df = spark.createDataFrame(
        [(None, "a b c d"), (5, "a b c d"), (7, None), (7, "a b c d"), (None, "lone text here")],
        "doc_id long, text string",
    ).selectExpr("doc_id", "text", "1 AS node", "2 AS sig", "'x' AS n")
    classes = jaccard_classes(df, 3, (9, 10))
    got = sorted(map(tuple, classes.drop("text_key").collect()), key=str)
    assert got == sorted(
        [(None, 2, 5), (5, 2, 5), (7, 0, 7), (7, 2, 5), (None, 1, None)], key=str
    )
    kept = first_of_each_class(df, classes)
    assert kept.columns == df.columns
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted(
        [(5, "a b c d"), (7, None), (None, "lone text here")], key=str
    )
    empty = df.limit(0)
    assert jaccard_classes(empty, 3, (9, 10)).count() == 0


def test_repeated_rows_stay_once(spark):
    df = spark.createDataFrame([(1, "a b c"), (1, "a b c"), (2, "a b c")], "doc_id long, text string")
    kept = first_of_each_class(df, jaccard_classes(df, 2, (4, 5)))
    assert [tuple(r) for r in kept.collect()] == [(1, "a b c")]


def test_components_of_paths_and_stars(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(100, k) for k in range(101, 140)] + [(500, 500)]
    got = connected_components(spark.createDataFrame(path + star, "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(i, 0) for i in range(41)] + [(i, 100) for i in range(100, 140)]


def test_level_table_follows_its_levels(spark):
    rows = [(i % 4, i, 1 + i % 3) for i in range(1000)]
    frequent = spark.createDataFrame(rows, "block int, low long, level int")
    table = jaccard_join._level_table(frequent, jaccard_join.MOST_LEVELS, jaccard_join.LEVEL_SLOTS)
    assert len(table) == jaccard_join.LEAST_SLOTS
    block, low, level = (np.array(c) for c in zip(*rows, strict=True))
    assert (table[jaccard_join._slot(block, low, len(table))] >= level).all()
