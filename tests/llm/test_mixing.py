from collections import defaultdict

from lexmill.llm.mixing import mix_sources


def shared(sizes):
    """Targets by sharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    whole, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = whole - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        for s in open_:
            target[s] = left * weight[s] / sum(weight[x] for x in open_)
        above = [s for s in open_ if target[s] > 3 * sizes[s]]
        for s in above:
            target[s] = 3.0 * sizes[s]
        if not above:
            return target
        capped.update(above)


def test_targets_and_taken(spark):
    rows = [(i, "w " * (1 + i * 7 % 50), f"s{i % 5}" if i % 5 else None) for i in range(600)]
    rows += [(1000 + i, "tiny", "tiny") for i in range(3)] + [(2000, None, "empty"), (2001, " ", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_sources(df.selectExpr("*", "0 AS size", "1 AS taken", "2 AS target")).collect()
    assert len(got) == len(rows)
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    target = shared(sizes)
    assert target["tiny"] == 9.0
    for r in got:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6
    assert sum(taken.values()) <= sum(sizes.values())
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 60
    again = mix_sources(df.repartition(7)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mix_sources(empty).collect() == []
    blank = spark.createDataFrame([(1, None, None), (None, "", "a")], empty.schema)
    assert sorted((r.size, r.taken, r.target) for r in mix_sources(blank).collect()) == [(0, 0, 0.0)] * 2
    same = spark.createDataFrame([(1, "a b", "s")] * 3 + [(None, "a", "s")], empty.schema)
    assert sum(r.taken for r in mix_sources(same).collect()) == 7
