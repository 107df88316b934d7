"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmill.session import Scratch


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``links``.

    Large-star and small-star steps in turn: every node is linked to the smallest node it
    knows. Each step takes a minimum per node, combined map-side, and joins it back, so no
    node's neighbours are ever gathered. Every round is written, which ends the lineage, and the
    round before it deleted. Without links, or with links of a node to itself only, the result is
    empty; repeated links count once.
    """
    scratch = Scratch()
    edges = scratch.written(
        links.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u"))
        .distinct(),
        "edges",
    )
    before = None
    while True:
        # every node's larger neighbours go to the smallest of its neighbourhood
        both = edges.union(edges.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = (
            both.filter("u > v")
            .join(least, "v")
            .select(F.col("u").alias("v"), F.col("m").alias("u"))
            .distinct()
        )
        # and its smaller ones too
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        moved = large.join(least, "v").select("u", "v", "m")
        small = (
            moved.select(F.col("u").alias("v"), F.col("m").alias("u"))
            .union(moved.select("v", F.col("m").alias("u")))
            .filter("v != u")
            .distinct()
        )
        last, edges = edges, scratch.written(small, "edges")
        scratch.drop(last)
        state = edges.agg(
            F.count(F.lit(1)).alias("n"),
            F.bit_xor(F.xxhash64("v", "u")).alias("x"),
            F.countDistinct("v").alias("nodes"),
        ).first()
        if state == before:
            break
        before = state
    roots = edges.select(F.col("u").alias("node")).distinct()
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
