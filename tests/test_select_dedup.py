"""Projections, sources, de-duplication and splits."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from lexmill.operators import dedup, select
from lexmill.operators.labels import require_labels
from lexmill.operators.splits import split_quotas, stratified_split
from lexmill.session import spread
from lexmill.sources import tables

SPLITS = tables.SPLITS


def test_combine(spark):
    row = ("A", None, " none ", "<NA>", "b ")
    df = spark.createDataFrame([row], "a string, b string, tag1 string, tag2 string, c string")
    assert select.columns_with_prefix(df) == ["tag1", "tag2"]
    out = select.combine_text(df, ["a", "b", "tag1", "tag2", "nowhere", "c"])
    assert out.first()["text_for_cluster"] == "A b"
    assert select.combine_text(df, ["nowhere"]).first()["text_for_cluster"] == ""


def test_lookup_table_and_mapping_agree(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    names = spark.createDataFrame([(1, "one")], "k int, name string")
    by_table = select.map_lookup(df, "k", names, "name").collect()
    by_dict = select.map_lookup(df, "k", {1: "one"}, "name").collect()
    assert sorted(map(str, by_table)) == sorted(map(str, by_dict))


def test_csv_round_trip(spark, tmp_path):
    columns = (*tables.ARTICLE_HEAD, *tables.ARTICLE_TAGS, *tables.ARTICLE_TAIL)
    schema = tables.article_schema(labelled=True)
    texts = ['with "quotes", commas', "two\nlines", " spaces ", "back\\slash", "é–"]
    rows = [(t, *[None] * 8, "s", "topic") for t in texts] + [("no topic", *[None] * 8, "s", None)]
    df = spark.createDataFrame(rows, schema)
    tables.write_labelled(df, str(tmp_path / "out"), columns)
    back = tables.read_articles(spark, str(tmp_path / "out"), schema)
    assert sorted(r["Judul"] for r in back.collect()) == sorted(texts)
    assert back.filter("tag1 is null").count() == len(texts)


def test_csv_header_must_match(spark, tmp_path):
    df = spark.createDataFrame([("x", "y")], "a string, topic string")
    tables.write_labelled(df, str(tmp_path / "out"), ["a"])
    wrong = tables.text_schema(["b", "topic"])
    with pytest.raises(Exception, match="CSV header"):
        tables.read_articles(spark, str(tmp_path / "out"), wrong).collect()


def test_within_counts_empty_once_but_normalized_drops_it(spark):
    df = spark.createDataFrame([(1, "x"), (2, ""), (3, None), (4, "x")], "id int, text string")
    assert {r["id"] for r in dedup.dedup_within(df, ["id"]).collect()} == {1, 2}
    assert {r["id"] for r in dedup.dedup_within(df, ["id"], keep="last").collect()} == {3, 4}
    assert dedup.removed_within(df).first()["removed"] == 2
    kept = dedup.drop_duplicates_normalized(df, ["text"], F.lower, ["id"], key_col="k")
    assert [r["id"] for r in kept.collect()] == [1]
    shown = dedup.drop_duplicates_normalized(
        df, ["text"], F.upper, ["id"], key_col="k", drop_key_col=False
    )
    assert [(r["id"], r["k"]) for r in shown.collect()] == [(1, "X")]


def test_guards(spark):
    df = spark.createDataFrame([(1, "x")], "id int, text string")
    with pytest.raises(KeyError, match="no column 'body'"):
        dedup.dedup_within(df, ["id"], "body")
    with pytest.raises(ValueError, match="at least one column"):
        dedup.drop_duplicates_normalized(df, [], F.lower, ["id"])
    bad = spark.createDataFrame([("a",), (" ",), (None,), ("NaN",)], "label string")
    with pytest.raises(ValueError, match="^3 rows"):
        require_labels(bad)


def _brute(rows, within, keep):
    """rows: (id, key, split). Plain restatement on lists."""

    def once(part):
        if not within:
            return part
        out = []
        for key in {k for _, k in part}:
            same = sorted(i for i, k in part if k == key)
            if keep is False:
                out += [(i, key) for i in same if len(same) == 1]
            else:
                out.append((same[0 if keep == "first" else -1], key))
        return out

    parts = [once([(i, k) for i, k, s in rows if s == split]) for split in SPLITS]
    seen, kept = set(), []
    for part in parts:
        stay = [(i, k) for i, k in part if k not in seen]
        seen |= {k for _, k in stay}
        kept.append({i for i, _ in stay})
    return [len(p) for p in parts], kept


@pytest.mark.parametrize(
    ("within", "keep"), [(True, "first"), (True, "last"), (True, False), (False, "first")]
)
def test_dedup_splits_against_lists(spark, within, keep):
    rng = random.Random(3)
    # one key holds about a third of the rows
    keys = ["hot"] * 10 + [f"k{i}" for i in range(20)]
    rows = [(i, rng.choice(keys), rng.choice(SPLITS)) for i in range(200)]
    df = spark.createDataFrame(rows, "id int, text string, split string")
    sizes, kept = _brute(rows, within, keep)
    out = dedup.dedup_split_table(df, ["id"], within=within, keep=keep).collect()
    for split, ids in zip(SPLITS, kept, strict=True):
        assert {r["id"] for r in out if r["split"] == split} == ids
    report = dedup.dedup_report(df, within=within, keep=keep).first()
    assert [report[f"{n}_after"] for n in ("train", "val", "test")] == [len(k) for k in kept]
    assert report["removed_val_vs_train"] == sizes[1] - len(kept[1])
    assert report["removed_test_vs_trainval"] == sizes[2] - len(kept[2])


def test_three_tables_and_no_overlap_left(spark):
    frames = [
        spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
        for texts in (["a", "b", "a"], ["b", "c"], ["c", "d", "a"])
    ]
    *kept, report = dedup.dedup_splits(*frames, ["id"])
    assert [[r["text"] for r in k.orderBy("id").collect()] for k in kept] == [
        ["a", "b"], ["c"], ["d"],
    ]
    assert report.first()["removed_train_within"] == 1
    stacked = tables.stack_splits(dict(zip(SPLITS, kept, strict=True)))
    counts = dedup.overlap_counts(stacked).first()
    assert (counts["train_val"], counts["train_test"], counts["val_test"]) == (0, 0, 0)
    assert (counts["train"], counts["val"], counts["test"]) == (2, 1, 1)


def test_stratified_sizes_with_a_dominant_label(spark):
    sizes = {"a": 700, "b": 203, "c": 50, "d": 12, "e": 3, "f": 1}
    names = [n for n, k in sizes.items() for _ in range(k)]
    df = spark.createDataFrame(list(enumerate(names)), "doc_id int, label string")
    quotas = {r["label"]: r for r in split_quotas(df).collect()}
    total = len(names)
    n_test = sum(q["n_test"] for q in quotas.values())
    n_val = sum(q["n_val"] for q in quotas.values())
    assert n_test == -(-total // 10)
    assert n_val == -(-(total - n_test) // 9)
    out = stratified_split(df)
    got = {(r["label"], r["split"]): r["n"] for r in
           out.groupBy("label", "split").agg(F.count("*").alias("n")).collect()}
    for label, q in quotas.items():
        assert abs(q["n_test"] - sizes[label] / 10) < 1
        assert got.get((label, "test"), 0) == q["n_test"]
        assert got.get((label, "validation"), 0) == q["n_val"]
        assert got.get((label, "train"), 0) == sizes[label] - q["n_test"] - q["n_val"]
    again = stratified_split(df.repartition(7), ranked_rows=3)  # searched digit by digit
    assert out.exceptAll(again).count() == 0


def test_samples_have_the_asked_size(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(
        (F.col("id") % 50).cast("string")).alias("g"))
    out = select.sample_per_group(df, "g", 5, "id").groupBy("g").count().collect()
    assert {r["count"] for r in out} == {5}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_copies_are_dropped_before_the_shuffle(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    plan = _plan(dedup.dedup_within(docs, ["doc_id"]))
    head, tail = plan.split("Exchange", 1)
    assert "WindowGroupLimit" in head
    assert "WindowGroupLimit" in tail


def test_narrow_scans_and_no_cartesian_products(spark, sf):
    from lexmill.plans.queries import QUERIES

    for name in ("dedup_splits", "stratified_split", "topic_examples", "label_share"):
        plan = _plan(QUERIES[name](spark, sf))
        assert "Cartesian" not in plan and "NestedLoop" not in plan
    plan = _plan(QUERIES["label_share"](spark, sf))
    assert "text" not in "".join(part.split(">")[0] for part in plan.split("ReadSchema: ")[1:])


@pytest.mark.parametrize("within", [True, False])
def test_unknown_splits_fail(spark, within):
    rows = [(1, "train", "a"), (2, "val", "a"), (3, "train", "b"), (4, None, "b")]
    df = spark.createDataFrame(rows, "id int, split string, text string")
    for job in (
        lambda: dedup.dedup_split_table(df, ["id"], within=within),
        lambda: dedup.dedup_report(df, within=within),
        lambda: dedup.overlap_counts(df),
    ):
        with pytest.raises(ValueError, match="None: 1 rows, 'val': 1 rows"):
            job()


def test_copies_inside_a_split_can_stay(spark):
    rows = [(1, "train", "a"), (2, "train", "a"), (3, "test", "a"), (4, "validation", "b"),
            (5, "validation", "b"), (6, "test", "b"), (7, "test", "c"), (8, "test", "c")]
    df = spark.createDataFrame(rows, "id int, split string, text string")
    kept = dedup.dedup_split_table(df, ["id"], within=False)
    assert sorted(r["id"] for r in kept.collect()) == [1, 2, 4, 5, 7, 8]
    assert kept.columns == df.columns


def test_spread_only_widens_narrow_scans(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert spread(docs, "doc_id").rdd.getNumPartitions() >= 4
    wide = spark.range(100).repartition(9)
    assert spread(wide, "id") is wide


def test_read_splits(spark, tmp_path):
    for name, value in itertools.product(SPLITS, ["t"]):
        spark.createDataFrame([(name, value)], "text string, label string").write.parquet(
            str(tmp_path / name)
        )
    schema = tables.text_schema(["text", "label"])
    df = tables.read_splits(spark, {n: str(tmp_path / n) for n in SPLITS}, schema)
    assert {(r["text"], r["split"]) for r in df.collect()} == {(n, n) for n in SPLITS}
