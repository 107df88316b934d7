"""Stratified splitting without gathering a label in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.select import shuffled_order
from lexmill.session import measured

# Hex digits of the hash that a step of the search descends (4,096 ranges).
_STEP_DIGITS = 3
_HASH_DIGITS = 32
# Rows of a range that are put in order in one task.
RANKED_ROWS = 65_536


def _quota(counts: DataFrame, rows: str, share: float, out: str) -> DataFrame:
    """Hand ``ceil(share * total)`` rows out over the labels, by largest remainder."""
    total = counts.agg(F.sum(rows)).scalar()
    # guard against a product that misses a whole number by a rounding error
    wanted = F.ceil(F.round(total * F.lit(share), 9))
    exact = F.col(rows) * wanted / total
    parted = counts.withColumn(out, F.floor(exact)).withColumn("_rest", exact - F.floor(exact))
    table = Window.orderBy(F.desc("_rest"), "label")
    missing = wanted - F.sum(out).over(Window.partitionBy())
    extra = F.when(F.row_number().over(table) <= missing, 1).otherwise(0)
    return parted.withColumn(out, F.col(out) + extra).drop("_rest")


def split_quotas(
    df: DataFrame, label_col: str = "label", test_share: float = 0.1, val_share: float = 1 / 9
) -> DataFrame:
    """Rows per label for test and validation: ``label, n, n_test, n_val``.

    Works on the label counts only. The validation share is taken from what the test
    split leaves.
    """
    labelled = df.filter(F.col(label_col).isNotNull())
    counts = measured(
        labelled.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    )
    with_test = _quota(counts, "n", test_share, "n_test")
    left = with_test.withColumn("_left", F.col("n") - F.col("n_test"))
    return _quota(measured(left), "_left", val_share, "n_val").drop("_left")


def stratified_split(
    df: DataFrame,
    label_col: str = "label",
    id_col: str = "doc_id",
    test_share: float = 0.1,
    val_share: float = 1 / 9,
    seed: int = 42,
    ranked_rows: int = RANKED_ROWS,
) -> DataFrame:
    """Add a ``split`` column: test, validation and train with exact sizes per label.

    Within a label rows go in a repeatable random order, the first to test, the next to
    validation. Only the two cut points of each label are searched, by their digits: counts
    per hash range show in which range a cut falls, and only such a range is counted by its
    next digits, until it has ``ranked_rows`` rows at most and is ranked. The rows
    themselves are then compared with their label's cuts, so no wide row is shuffled and
    a label holding most of the table is no hot spot. Rows without a label get no split.
    """
    order = shuffled_order(id_col, seed)
    narrow = df.select(
        F.col(label_col).alias("label"), F.col(id_col).alias("_id"), order.alias("_hash")
    )
    quotas = measured(split_quotas(df, label_col, test_share, val_share))
    cut = F.explode(F.array(F.col("n_test"), F.col("n_test") + F.col("n_val"))).alias("_cut")
    cuts = measured(quotas.select("label", cut).filter("_cut > 0").distinct())
    digits = 0
    holding = measured(
        quotas.select(
            "label", F.lit("").alias("_range"), F.lit(0).cast("long").alias("_from"), "n"
        ).join(cuts, "label")
    )
    while digits < _HASH_DIGITS and (holding.agg(F.max("n")).first()[0] or 0) > ranked_rows:
        above = holding.select("label", F.col("_range").alias("_above"), "_from").distinct()
        # ranges of a step: 4,096 per label and cut
        ranges = (
            narrow.withColumn("_above", F.substring("_hash", 1, digits))
            .join(measured(above), ["label", "_above"])
            .groupBy("label", "_above", "_from", F.substring("_hash", 1, digits + _STEP_DIGITS).alias("_range"))
            .agg(F.count(F.lit(1)).alias("n"))
        )
        upto = F.sum("n").over(Window.partitionBy("label", "_above").orderBy("_range"))
        holding = measured(
            ranges.withColumn("_from", F.col("_from") + upto - F.col("n"))
            .join(cuts, "label")
            .filter((F.col("_from") < F.col("_cut")) & (F.col("_cut") <= F.col("_from") + F.col("n")))
            .select("label", "_range", "_from", "n", "_cut")
        )
        digits += _STEP_DIGITS
    narrow = narrow.withColumn("_range", F.substring("_hash", 1, digits))
    spans = measured(holding.select("label", "_range", "_from").distinct())
    place = F.row_number().over(Window.partitionBy("label", "_range").orderBy("_hash", "_id"))
    ranked = narrow.join(spans, ["label", "_range"]).withColumn(
        "_place", place + F.col("_from")
    )
    found = ranked.join(
        holding.select("label", "_range", F.col("_cut").alias("_place")),
        ["label", "_range", "_place"],
    ).select("label", "_place", F.struct("_hash", "_id").alias("_at"))
    limits = measured(
        quotas.join(found, "label", "left")
        .groupBy("label")
        .agg(
            F.max(F.when(F.col("_place") == F.col("n_test"), F.col("_at"))).alias("_test_at"),
            F.max(
                F.when(F.col("_place") == F.col("n_test") + F.col("n_val"), F.col("_at"))
            ).alias("_val_at"),
        )
        .withColumnRenamed("label", "_label")
    )
    me = F.struct(order.alias("_hash"), F.col(id_col).alias("_id"))
    split = (
        F.when(F.col("_label").isNull(), None)
        .when(me <= F.col("_test_at"), "test")
        .when(me <= F.col("_val_at"), "validation")
        .otherwise("train")
    )
    joined = df.join(limits, F.col(label_col) == F.col("_label"), "left")
    return joined.withColumn("split", split).drop("_label", "_test_at", "_val_at")


def union_splits(df: DataFrame, *names: str, split_col: str = "split") -> DataFrame:
    """Rows of the named splits together, as used for the refit."""
    return df.filter(F.col(split_col).isin(*names))
