"""What a task holds or sends, on rows made here."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lexmill.functions.grams import CharGrams, Words
from lexmill.functions.ngrams import char_ngrams, word_ngrams
from lexmill.operators import svm, tfidf
from lexmill.session import dealt


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_repeated_words_are_cut_once():
    column = pa.array([["abc", "de"] * 500, [], ["de", "é"]], pa.list_(pa.string()))
    grams = CharGrams(Words.of(column, range(3)))
    assert len(grams._ids) < 20
    names = grams.strings(np.arange(len(grams.hashes))).to_pylist()
    got = [dict(zip([names[i] for i in ids], map(int, n))) for ids, n in grams.documents()]
    assert got[0][" ab"] == got[0]["de "] == 500 and got[1] == {}
    assert got[2] == {" de": 1, "de ": 1, " de ": 1, " é ": 1}


def test_listed_grams_equal_rows_without_shuffle_or_sort(spark):
    rows = [(1, ["Ab cd", "cd"]), (2, ["", "x"]), (3, []), (None, ["Éa bb bb"])]
    df = spark.createDataFrame(rows, "d long, texts array<string>")
    flat = df.selectExpr("d", "explode(texts) text")
    for grams, more in ((char_ngrams, []), (word_ngrams, [2])):
        listed = grams(df, "texts", ["d"], *more, listed=True)
        plan = _plan(listed)
        assert "Exchange" not in plan and "Sort " not in plan and "Aggregate" not in plan
        want = {}
        for r in grams(flat, "text", ["d"], *more).collect():
            want.setdefault(r["d"], []).append(r["term"])
        assert {r["d"]: r["terms"] for r in listed.collect()} == {k: sorted(v) for k, v in want.items()}


def test_scores_meet_all_classes_in_one_row(spark, monkeypatch, request):
    # a coefficient table of real size is no automatic broadcast
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.autoBroadcastJoinThreshold"))
    docs = spark.createDataFrame([(1,), (1,), (2,), (3,)], "d long")
    features = spark.createDataFrame(
        [(1, 0, 1.0), (1, 1, 2.0), (2, 1, 1.0), (2, 9, 5.0)], "d long, idx int, weight double"
    )
    rows = [("a", -1, 0.5), ("a", 0, 1.0), ("a", 0, 1.0), ("b", -1, 1.0), ("b", 1, 3.0), ("c", 1, 4.0)]
    coefficients = spark.createDataFrame(rows, "class string, idx int, weight double")
    want = {(1, "a"): 3.0, (1, "b"): 8.0, (1, "c"): 8.0, (2, "a"): 0.5, (2, "b"): 4.0,
            (2, "c"): 4.0, (3, "a"): 0.5, (3, "b"): 1.0}
    for at_once in (32, 2):
        monkeypatch.setattr(svm, "CLASSES_AT_ONCE", at_once, raising=False)
        scores = svm.class_scores(features, docs, coefficients, ["d"])
        assert {(r["d"], r["class"]): r["score"] for r in scores.collect()} == want
        assert "SortMergeJoin" not in _plan(scores)
    assert svm.class_scores(features, docs, coefficients.limit(0), ["d"]).count() == 0


def test_rows_are_dealt_by_count(spark):
    rows = spark.range(0, 500_000, numPartitions=8).withColumnRenamed("id", "n")
    parts = dealt(rows, "n").rdd.glom().map(len).collect()
    assert sum(parts) == 500_000 and max(parts) <= 100_000


def test_workers_get_few_documents_at_once(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["rows"])

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        docs = spark.range(0, 3000, 1, 8).select(F.lit("a text").alias("text")).coalesce(1)
        tokens = tfidf._tokenized(docs, [], "text").coalesce(1)
        rows = [r["rows"] for r in tokens.mapInArrow(sizes, "rows long").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(rows) == 3000 and max(rows) <= 1000


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["rows"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "64m")
    try:
        # a row of 4 MB: its words and its pieces
        text = F.expr("repeat('word ', 400000)").alias("text")
        tokens = tfidf._tokenized(spark.range(0, 16, 1, 8).select(text), [], "text").coalesce(1)
        rows = [r["rows"] for r in tokens.mapInArrow(sizes, "rows long").collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(rows) == 16 and max(rows) <= 4
