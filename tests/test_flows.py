"""The three flows from articles to results."""

from pyspark.sql import functions as F

from lexmill.operators.classifier import Settings
from lexmill.plans.flows import long_text_flow, short_text_flow, topic_flow
from lexmill.plans.queries import split_of

PARAMS = {"ngram_max": 1, "min_df": 1, "max_df": 0.95, "word_max_features": 300,
          "char_max_features": 300, "C": 1.0}
SETTINGS = Settings(max_iter=5, min_bucket_size=10, min_label_support=5, n_clusters=2)


def _documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_long_text(spark, sf):
    articles = _documents(spark, sf).select(
        "doc_id", F.col("source").alias("Judul"), F.col("text").alias("Content"),
        F.col("lang").alias("topic"),
    )
    _, evaluation = long_text_flow(articles, "doc_id", params=PARAMS, settings=SETTINGS)
    assert evaluation["scores"].first()["micro_f1"] > 0.8


def test_short_text(spark, sf):
    splits = _documents(spark, sf).select(
        "doc_id", "text", F.col("lang").alias("label"), split_of().alias("split")
    )
    out = short_text_flow(splits, params=PARAMS, settings=SETTINGS)
    after = out["overlap_after"].first()
    assert after["train_val"] == after["train_test"] == after["val_test"] == 0
    assert out["report"].first()["train_after"] == after["train"]
    assert out["evaluation"]["scores"].first()["micro_f1"] > 0.8


def test_topics(spark, sf):
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select(
        F.col("vec_id").alias("doc_id"), "embedding"
    )
    articles = (
        _documents(spark, sf)
        .join(vectors, "doc_id")
        .select("doc_id", F.col("source").alias("Judul"), F.col("text").alias("Content"),
                "embedding")
    )
    out = topic_flow(articles, k=4, names={0: "first"})
    assert out["documents"].count() == articles.count()
    assert out["info"].agg(F.sum("count")).first()[0] == articles.count()
    assert out["terms"].count() > 0
    assert out["selected_documents"].count() <= articles.count()
