"""Article tables, pre-split datasets and labelled output."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

# Column names of the article files.
ARTICLE_HEAD = ("Judul", "Waktu", "Link", "Content")
ARTICLE_TAGS = ("tag1", "tag2", "tag3", "tag4", "tag5")
ARTICLE_TAIL = ("source",)
TOPIC_COLUMN = "topic"

SPLITS = ("train", "validation", "test")


def text_schema(columns: Sequence[str]) -> StructType:
    return StructType([StructField(c, StringType(), True) for c in columns])


def article_schema(labelled: bool = False) -> StructType:
    columns = (*ARTICLE_HEAD, *ARTICLE_TAGS, *ARTICLE_TAIL)
    return text_schema((*columns, TOPIC_COLUMN) if labelled else columns)


def read_articles(
    spark: SparkSession, path: str, schema: StructType | None = None, fmt: str = "csv"
) -> DataFrame:
    """Read article files under an explicit schema; the CSV header must match it.

    Quoted line breaks make a CSV file one task's work, so large collections should
    come as many files or as Parquet.
    """
    reader = spark.read.schema(schema or article_schema())
    if fmt == "csv":
        reader = (
            reader.option("header", True)
            .option("enforceSchema", False)
            .option("multiLine", True)
            .option("quote", '"')
            .option("escape", '"')
        )
    return reader.format(fmt).load(path)


def read_splits(
    spark: SparkSession,
    paths: Mapping[str, str],
    schema: StructType | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    """Read named splits into one table with a ``split`` column."""
    return stack_splits(
        {name: read_articles(spark, path, schema, fmt) for name, path in paths.items()}
    )


def stack_splits(frames: Mapping[str, DataFrame]) -> DataFrame:
    parts = [df.withColumn("split", F.lit(name)) for name, df in frames.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def labelled_rows(df: DataFrame, columns: Sequence[str], topic_col: str = TOPIC_COLUMN) -> DataFrame:
    """Rows that have a topic, in the output column order."""
    return df.filter(F.col(topic_col).isNotNull()).select(*columns, topic_col)


def write_labelled(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    topic_col: str = TOPIC_COLUMN,
    fmt: str = "csv",
) -> None:
    """Write the labelled rows as CSV (header, doubled quotes) or Parquet."""
    writer = labelled_rows(df, columns, topic_col).write.mode("overwrite")
    if fmt == "csv":
        writer = (
            writer.option("header", True)
            .option("quote", '"')
            .option("escape", '"')
            .option("ignoreLeadingWhiteSpace", False)
            .option("ignoreTrailingWhiteSpace", False)
        )
    writer.format(fmt).save(path)
