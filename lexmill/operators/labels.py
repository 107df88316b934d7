"""Label checks, casts, counts and codes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BooleanType,
    DecimalType,
    FractionalType,
    IntegralType,
    StringType,
)

from lexmill import fixed_values as fv
from lexmill.functions.text import DIGIT, strip
from lexmill.session import measured, numbered
from lexmill.sources.tables import SPLITS


def clean_label(c: Column) -> Column:
    """The stripped label; null where it is missing, blank or the missing word."""
    bare = F.regexp_replace(strip(c.cast("string")), rf"(?i)^{fv.MISSING_WORD}\z", "")
    return F.nullif(bare, F.lit(""))


def invalid_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.agg(F.count_if(clean_label(F.col(label_col)).isNull()).alias("invalid"))


def require_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Labels as stripped strings; fails with the count when any is invalid."""
    bad = invalid_labels(df, label_col).first()["invalid"]
    if bad:
        raise ValueError(f"{bad} rows without a usable label in {label_col}")
    return df.withColumn(label_col, clean_label(F.col(label_col)))


def _is_fraction_type(dtype) -> bool:
    return isinstance(dtype, FractionalType) and not isinstance(dtype, DecimalType)


def _present(c: Column, dtype) -> Column:
    return c.isNotNull() & ~F.isnan(c) if _is_fraction_type(dtype) else c.isNotNull()


def label_is_integer(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Whether the labels are whole numbers: one row, column ``is_integer``.

    True for integer columns, for floating columns with only whole values, and when
    every label reads as an optional minus and digits. False without labels.
    """
    dtype = df.schema[label_col].dataType
    c = F.col(label_col)
    if isinstance(dtype, IntegralType):
        test = F.lit(True)
    elif _is_fraction_type(dtype):
        test = c % 1 == 0
    else:
        test = strip(c.cast("string")).rlike(rf"^-?{DIGIT}+\z")
    whole = F.bool_and(F.when(_present(c, dtype), test))
    return df.agg(F.coalesce(whole, F.lit(False)).alias("is_integer"))


def coerce_labels(df: DataFrame, label_col: str = "label", as_str: bool = False) -> DataFrame:
    """Drop rows without a label and settle the label type; other columns stay aligned.

    ``as_str``: stripped text without blanks or missing words. Otherwise whole floating
    labels become integers and fractional ones text.
    """
    dtype = df.schema[label_col].dataType
    if not isinstance(dtype, (StringType, IntegralType, FractionalType, BooleanType)):
        raise ValueError(f"Bad label target type: {dtype.simpleString()}")
    c = F.col(label_col)
    kept = df.filter(_present(c, dtype))
    if as_str:
        return kept.withColumn(label_col, clean_label(c)).filter(c.isNotNull())
    if _is_fraction_type(dtype):
        whole = label_is_integer(kept, label_col).first()["is_integer"]
        return kept.withColumn(label_col, c.cast("bigint" if whole else "string"))
    return kept


def encode_labels(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Sorted distinct labels with codes from 0: ``label, code``."""
    distinct = df.select(F.col(label_col).alias("label")).filter("label is not null").distinct()
    codes = numbered(distinct, [F.col("label")], "code")
    return codes.withColumn("code", F.col("code") - 1)


def label_support(
    df: DataFrame, label_col: str = "label", min_support: int = fv.MIN_LABEL_SUPPORT
) -> DataFrame:
    """Rows per label and whether they reach the threshold: ``label, n, kept``."""
    counts = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("kept", F.col("n") >= min_support)


def label_share(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Percentage per label without nulls, largest first: ``label, percent``."""
    # cached, so that the total does not count the table a second time
    counts = measured(label_support(df.filter(F.col(label_col).isNotNull()), label_col))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        "label", (F.col("n") * 100.0 / total).alias("percent")
    ).orderBy(F.desc("percent"), "label")


def label_by_split(
    df: DataFrame,
    label_col: str = "label",
    split_col: str = "split",
    splits: Sequence[str] = SPLITS,
    top_n: int | None = 25,
) -> DataFrame:
    """Rows per label and split with a total, largest total first; null is a label."""
    counts = [F.count_if(F.col(split_col) == s).alias(s) for s in splits]
    table = df.groupBy(F.col(label_col).alias("label")).agg(*counts)
    total = sum((F.col(s) for s in splits), F.lit(0).cast("bigint"))
    ranked = table.withColumn("total", total).orderBy(F.desc("total"), "label")
    return ranked if top_n is None else ranked.limit(top_n)
