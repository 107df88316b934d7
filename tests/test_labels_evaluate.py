"""Labels, evaluation tables and topics."""

import pytest
from pyspark.sql import functions as F

from lexmill.operators import evaluate, labels, topics


def _whole(spark, values, kind):
    df = spark.createDataFrame([(v,) for v in values], f"label {kind}")
    return labels.label_is_integer(df).first()["is_integer"]


def test_label_is_integer(spark):
    assert _whole(spark, [1.0, 2.0, None, float("nan")], "double")
    assert not _whole(spark, [1.5, 2.0], "double")
    assert _whole(spark, ["-3", " 7 "], "string")
    assert not _whole(spark, ["-3", "x"], "string")
    assert _whole(spark, [1, None], "int")
    assert not _whole(spark, [None], "int")
    assert not _whole(spark, [None], "string")


def test_coerce(spark):
    def run(values, kind, **kw):
        df = spark.createDataFrame(list(enumerate(values)), f"i int, label {kind}")
        return [(r["i"], r["label"]) for r in labels.coerce_labels(df, **kw).orderBy("i").collect()]

    assert run([1.0, None, 2.0, float("nan")], "double") == [(0, 1), (2, 2)]
    assert run([1.5, 2.0], "double") == [(0, "1.5"), (1, "2.0")]
    assert run([" a ", "NaN", None, " "], "string", as_str=True) == [(0, "a")]
    assert run(["a", None], "string") == [(0, "a")]
    with pytest.raises(ValueError, match="Bad label target"):
        run([["a"]], "array<string>")


def test_codes_and_shares(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "label string")
    codes = {r["label"]: r["code"] for r in labels.encode_labels(df).collect()}
    assert codes == {"a": 0, "b": 1}
    share = labels.label_share(df).collect()
    assert [(r["label"], round(r["percent"], 3)) for r in share] == [("b", 66.667), ("a", 33.333)]


def test_evaluation_example(spark):
    rows = [("a", "a"), ("a", "c"), ("b", "b")]
    out = evaluate.evaluate(spark.createDataFrame(rows, "label string, pred string"))
    assert out["confusion"].collect()[0].asDict() == {"true": "a", "a": 1, "b": 0}
    report = [r["label"] for r in out["report"].collect()]
    assert report == ["a", "b", "c", "accuracy", "macro avg", "weighted avg"]
    scores = out["scores"].first()
    assert scores["macro_f1"] == pytest.approx((2 / 3 + 1 + 0) / 3)
    assert scores["micro_f1"] == pytest.approx(2 / 3)
    # the predicted label c is never true, so it is no cell of the matrix
    assert out["top_confusions"].count() == 0


def test_confusion_total(spark, sf):
    from lexmill.plans.queries import scored_documents

    scored = scored_documents(spark, sf)
    cells = evaluate.confusion(evaluate.pair_counts(scored))
    seen = [r["label"] for r in scored.select("label").distinct().collect()]
    assert cells.agg(F.sum("n")).first()[0] == scored.filter(F.col("pred").isin(seen)).count()


def test_unit_embeddings(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "embedding array<float>")
    out = [r["embedding"] for r in topics.unit_embeddings(df).collect()]
    assert out[0] == pytest.approx([0.6, 0.8])
    assert out[1] == [0.0, 0.0]


def test_noise_can_be_selected(spark):
    info = spark.createDataFrame(
        [(-1, 90), (0, 80), (1, 70), (2, 10)], "topic int, count bigint"
    )
    picked = topics.select_topics(info, head=1, min_count=60, tail=3)
    assert {r["topic"] for r in picked.collect()} == {-1, 0, 1}
    cover = topics.topic_coverage(info, head=1, min_count=60, tail=3).first()
    assert (cover["rows"], cover["topics"]) == (80 + 90 + 80 + 70, 3)


def test_small_clusters_become_noise(spark):
    df = spark.createDataFrame(
        [(i, c) for i, c in enumerate([5] * 3 + [2] * 4 + [9] + [-1] * 6)], "id int, cluster int"
    )
    out = topics.renumber_clusters(df, min_size=2).groupBy("cluster").count().collect()
    assert {(r["cluster"], r["count"]) for r in out} == {(0, 4), (1, 3), (-1, 7)}


def test_clusters_follow_directions(spark):
    rows = [(i, [1.0, 0.01 * i] if i % 2 else [0.01 * i, 1.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "id int, embedding array<float>")
    out = topics.cluster_documents(df, k=2, min_size=5)
    groups = {(r["id"] % 2, r["cluster"]) for r in out.collect()}
    assert len(groups) == 2
