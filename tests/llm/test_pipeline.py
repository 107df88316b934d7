"""The corpus pipeline, stage by stage and as a whole."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"


def test_stages():
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "quality", "near_duplicates", "decontamination", "mixing"]


def test_whole_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    sizes, kept = [], docs
    for name, stage in corpus_pipeline.STAGES:
        before, kept = kept, corpus_pipeline.written(stage(spark, kept, SF), name)
        sizes.append(kept.count())
        if name != "mixing":
            assert kept.columns == docs.columns
            assert kept.join(before, "doc_id", "left_anti").isEmpty()
        if name == "quality":
            clean = before.join(labels.filter("quality = 1"), "doc_id").count()
            assert kept.join(labels.filter("quality = 1"), "doc_id").count() > 0.97 * clean
    assert sizes == sorted(sizes, reverse=True) and sizes[-1] > 300
    assert kept.columns == ["doc_id", "source", "size", "source_size", "target", "taken"]
    per_source = kept.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"))
    # a source may miss its target by about one document
    assert all(abs(r.taken - r.target) < 6000 for r in per_source.collect())


@pytest.mark.parametrize("name", ["language", "near_duplicates", "decontamination", "mixing"])
def test_odd_documents(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string"
    text = "the quick brown fox jumps over the lazy dog near the river bank " * 4
    rows = [(1, text, "en", "s", 1, "x"), (2, text, "en", None, None, None), (3, None, None, None, None, None),
            (4, "", "en", "s", 0, None), (None, "some other words of the same tongue that stand alone", "en", "s", 5, "y")]
    df = spark.createDataFrame(rows, schema)
    out = stage(spark, df, SF)
    if name != "mixing":
        assert out.columns == df.columns
    ids = {r.doc_id for r in out.collect()}
    expected = {"near_duplicates": {1, 3, 4, None}, "decontamination": {1, 2, 3, 4, None}}
    assert ids == expected[name] if name in expected else ids
    assert stage(spark, df.limit(0), SF).count() == 0
