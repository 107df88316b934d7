"""Projections, filters, lookups and samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill import fixed_values as fv
from lexmill.functions.text import strip
from lexmill.session import measured


def text_label(df: DataFrame, text_col: str, label_col: str, *keep: Column | str) -> DataFrame:
    return df.select(
        *keep, F.col(text_col).alias("text"), F.col(label_col).cast("string").alias("label")
    )


def columns_with_prefix(df: DataFrame, prefix: str = "tag") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def _present(c: Column) -> Column:
    """Stripped text, or null where the value counts as missing."""
    words = "|".join(fv.COMBINE_MISSING_WORDS)
    # one expression over one input: a missing word is cut away, and nullif drops blanks
    bare = F.regexp_replace(strip(c.cast("string")), rf"(?i)^(?:{words})\z", "")
    return F.nullif(bare, F.lit(""))


def combined_text(df: DataFrame, columns: Sequence[str], sep: str = " ") -> Column:
    """Join the present values of ``columns``; a column ``df`` lacks counts as empty."""
    known = [c for c in columns if c in df.columns]
    if not known:
        return F.lit("")
    return strip(F.concat_ws(sep, *(_present(F.col(c)) for c in known)))


def combine_text(
    df: DataFrame, columns: Sequence[str], sep: str = " ", out_col: str = "text_for_cluster"
) -> DataFrame:
    return df.withColumn(out_col, combined_text(df, columns, sep))


def non_empty(df: DataFrame, text_col: str, min_length: int = 1) -> DataFrame:
    return df.filter(F.length(text_col) >= min_length)


def in_set(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose ``column`` occurs in the table ``wanted`` (same column name)."""
    return df.join(measured(wanted.select(column).distinct()), column, "left_semi")


def map_lookup(
    df: DataFrame, column: str, mapping: Mapping | DataFrame, out_col: str
) -> DataFrame:
    """Look ``column`` up; unmapped values give null.

    A dictionary is part of the plan; a table ``(column, out_col)`` is joined.
    """
    if isinstance(mapping, DataFrame):
        return df.join(measured(mapping), column, "left")
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return df.withColumn(out_col, F.create_map(*pairs)[F.col(column)])


def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def first_per_group(df: DataFrame, group_col: str, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of every group.

    Spark prunes each map task to ``n`` rows per group before the shuffle, so a group
    holding a large part of the table moves no more than a small one.
    """
    rank = F.row_number().over(Window.partitionBy(group_col).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def shuffled_order(id_col: str, seed: int) -> Column:
    """A repeatable random order: the digest of seed and id."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(id_col).cast("string")))


def sample_per_group(
    df: DataFrame, group_col: str, n: int, id_col: str = "doc_id", seed: int = 42
) -> DataFrame:
    """Up to ``n`` rows per group in a repeatable random order."""
    return first_per_group(df, group_col, n, shuffled_order(id_col, seed), id_col)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct()


def row_count(df: DataFrame, *group_cols: str) -> DataFrame:
    return df.groupBy(*group_cols).agg(F.count(F.lit(1)).alias("n"))


def preview(df: DataFrame, order_by: str, n: int = 5) -> DataFrame:
    return df.orderBy(order_by).limit(n)
