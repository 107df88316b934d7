"""Training corpus from raw documents: five stages of the ``llm`` operators, each written and
reread as the next one's input.

Empty and null texts, repeated rows, nulls and further columns are treated as each operator's
docstring says; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.llm.decontamination import find_leaks, without_leaks
from lexmill.llm.jaccard_join import first_of_each_class, jaccard_classes
from lexmill.llm.language_id import fuse_languages, train_languages
from lexmill.llm.mixing import mix_sources
from lexmill.llm.quality_cnn import score_quality, train_quality
from lexmill.llm.queries import quality_labels
from lexmill.session import written

QUALITY_LEAST = 0.7


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a recognised language, which becomes their ``lang``. The ``lang`` given
    is the declared language, the source takes the part of the host."""
    model = train_languages(docs.select("text", "lang"))
    fused = fuse_languages(
        docs, model, F.col("text"), F.col("lang"), host=F.col("source"), suffix=F.lit("")
    )
    kept = fused.filter(~F.col("rejected")).withColumn("lang", F.col("language"))
    return kept.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches ``QUALITY_LEAST``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = score_quality(docs, train_quality(docs, quality_labels(labels)))
    return scored.filter(F.col("score") >= QUALITY_LEAST).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five words, a similarity of 0.8."""
    return first_of_each_class(docs, jaccard_classes(docs, size=5, similarity=(4, 5)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without_leaks(docs, find_leaks(docs, benchmark))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row per document that it takes, with the words it takes of it."""
    return mix_sources(docs).filter("taken > 0")


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs


# the quality network has no SQL form
ORACLE_SQL = None
