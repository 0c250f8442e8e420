"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.shared import keep


def _mins(both: DataFrame) -> DataFrame:
    return both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star step over edges (a, b)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    mins = _mins(both)
    large = both.where("b > a").join(mins, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
    down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    mins = _mins(down)
    joined = down.join(mins, F.col("a") == F.col("u"))
    small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
    return small.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, label for every node of edges (a, b): label is the smallest node it reaches.

    Each step is a written table, so no lineage grows; steps are logarithmic in the longest
    path. Nothing but two numbers a step comes to the driver.
    """
    now, seen = keep(edges.select("a", "b").where("a <> b").distinct(), "edges"), None
    while True:
        now = keep(_stars(now), "stars")
        mark = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == tuple(mark):
            break
        seen = tuple(mark)
    out = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return out.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
