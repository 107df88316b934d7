"""Mixing sources to target weights by weighted fair queueing.

Each source is a queue of its documents in a hashed order, gone through up to
``max_repeats`` times. An entry's virtual finish time is the source's words up to and with
it, divided by the source's target; the entries of all sources are sorted by that time over
the whole cluster and taken until the budget, the words of all documents, is spent. Only
DataFrame functions are used. Running totals come from range partitions and one total per
partition, so a source that holds most rows is spread like any other rows.

Defined cases: a null text has no words; words are runs of characters other than space and
U+0009 to U+000D; a null source is a source of its own and the last; documents without words
are returned and take nothing; repeated rows are entries of their own; an empty table gives
an empty result; columns other than the id, source and text are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import written

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str]) -> DataFrame:
    """``df`` with inclusive running totals in a global order: name -> summed column.

    Rows are range-sorted and written with their range's number; the totals of earlier
    ranges, one row per range, are added to the totals inside a range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id())
    ranged = written(ranged, "ranged")
    sums = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_{k}") for k, c in totals.items()])
    # one row per range: as many as partitions, whatever the table's size
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(
        "_range", *[F.coalesce(F.sum(f"_{k}").over(earlier), F.lit(0)).alias(f"_{k}") for k in totals]
    )
    inside = (
        Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    )
    added = {k: F.col(f"_{k}") + F.sum(c).over(inside) for k, c in totals.items()}
    return (
        ranged.join(F.broadcast(starts), "_range")
        .withColumns(added)
        .drop("_range", *[f"_{k}" for k in totals])
    )


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeats: int) -> DataFrame:
    """Target words of each source. ``sizes``: ``source`` (distinct), ``source_size``.

    A target is the source's share by weight of what capped sources leave, capped at
    ``max_repeats`` times the source: the limit of sharing the excess again and again.
    Returns ``source, source_size, number, before, target``: its number in code point order,
    null last, and the words of the sources before it.
    """
    numbered = running_totals(
        sizes.withColumn("_one", F.lit(1).cast("long")),
        [F.col("source").asc_nulls_last()],
        {"number": "_one", "upto": "source_size"},
    ).withColumns(
        {
            "before": F.col("upto") - F.col("source_size"),
            "cap": max_repeats * F.col("source_size"),
            "weight": F.element_at(
                F.array(*[F.lit(w).cast("long") for w in weights]),
                (F.pmod(F.col("number") - 1, F.lit(len(weights))) + 1).cast("int"),
            ),
        }
    )
    ranked = running_totals(
        numbered, [F.col("cap") / F.col("weight"), F.col("number")], {"caps": "cap", "shares": "weight"}
    )
    ranked = written(ranked, "sources")
    whole = ranked.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    words, weight = whole["words"] or 0, whole["weight"] or 0
    # before a source, in order of cap over weight: what earlier, capped sources leave
    left = F.lit(words).cast("decimal(38,0)") - (F.col("caps") - F.col("cap"))
    rest = F.lit(weight).cast("decimal(38,0)") - (F.col("shares") - F.col("weight"))
    below = F.col("cap") * rest >= F.col("weight") * left
    level = (
        ranked.filter(below)
        .select("caps", left.cast("double").alias("left"), rest.cast("double").alias("rest"),
                (F.col("cap") / F.col("weight")).alias("ratio"), "number")
        .agg(F.min(F.struct("ratio", "number", "left", "rest")).alias("first"))
        .first()["first"]
    )
    share = level["left"] / level["rest"] if level else 0.0
    target = F.least(F.col("cap").cast("double"), F.col("weight") * F.lit(share))
    return ranked.select("source", "source_size", "number", "before", target.alias("target"))


def mix_sources(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeats: int = 3,
    doc_id: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target, taken``.

    ``taken`` counts the words of the repeats that the mix takes, whole documents only.
    """
    sized = written(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).alias("source"),
            word_count(F.col(text)).alias("size"),
            F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("_key"),
            F.lit(1).cast("long").alias("_one"),
        ),
        "sized",
    )
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats)
    order = [F.col("source").asc_nulls_last(), F.col("_key"), F.col("doc_id"), F.col("size")]
    queued = running_totals(sized, order, {"_row": "_one", "_upto": "size"})
    # at most one row per source; Catalyst broadcasts them only if they are few
    queued = (
        queued.join(
            targets.select(
                F.col("source").alias("_source"), "source_size", "number", "before", "target"
            ),
            F.col("source").eqNullSafe(F.col("_source")),
        )
        .withColumn("_queue", F.col("_upto") - F.col("before"))
        .drop("_source", "_upto", "before", "_key", "_one")
    )
    queued = written(queued, "queued")

    def finish(turn: Column) -> Column:
        # a source without words has no target, and its documents no entries
        return (turn * F.col("source_size") + F.col("_queue")) / F.nullif("target", F.lit(0.0))

    entry = F.struct("time", "number", "_row", "_turn")
    entries = (
        queued.filter("size > 0")
        .select("number", "_row", "size", "source_size", "_queue", "target",
                F.explode(F.sequence(F.lit(0), F.lit(max_repeats - 1))).alias("_turn"))
        .select(finish(F.col("_turn")).alias("time"), "number", "_row", "_turn", "size")
    )
    in_time = [F.col("time"), F.col("number"), F.col("_row"), F.col("_turn")]
    budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first()["n"]
    last = (
        running_totals(entries, in_time, {"_spent": "size"})
        .filter(F.col("_spent") <= F.lit(budget))
        .agg(F.max(entry).alias("last"))
        .first()["last"]
    )
    taken = F.lit(0).cast("long")
    if last is not None:
        cut = F.struct(
            F.lit(last["time"]).alias("time"), F.lit(last["number"]).alias("number"),
            F.lit(last["_row"]).alias("_row"), F.lit(last["_turn"]).alias("_turn"),
        )
        for turn in range(max_repeats):
            mine = F.struct(
                finish(F.lit(turn)).alias("time"), F.col("number"), F.col("_row"),
                F.lit(turn).alias("_turn"),
            )
            taken = taken + F.when((F.col("size") > 0) & (mine <= cut), F.col("size")).otherwise(0)
    return queued.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
