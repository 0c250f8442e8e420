"""Few pins that make another router walk a given route: a least-cost path over the route's corners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pins(legs: DataFrame, limit: int) -> DataFrame:
    """route, pins (anchors between the first and the last, in order), lost: the at most limit pins of each route with
    the least sum over its legs (route, a, b, cost) from anchor a to a later anchor b; 0 is the first anchor, the
    greatest b the last. Of equal sums the fewer pins, then from the end the earlier anchors.

    A round adds a leg to the best ways of its length to each anchor: limit + 1 joins on the route, with no more rows
    a route than it has legs."""
    last = legs.groupBy("route").agg(F.max("b").alias("end"))
    state = F.struct("lost", "a", "pins")
    now = legs.where("a = 0").select("route", "b", F.col("cost").alias("lost"), F.array().cast("array<long>").alias("pins"))
    found = [now.withColumn("n", F.lit(0))]
    for n in range(1, limit + 1):
        step = now.select("route", F.col("b").alias("a"), "lost", "pins").join(legs, ["route", "a"])
        step = step.select("route", "b", (F.col("lost") + F.col("cost")).alias("lost"), "a", F.concat("pins", F.array(F.col("a").cast("long"))).alias("pins"))
        now = step.groupBy("route", "b").agg(F.min(state).alias("m")).select("route", "b", "m.lost", "m.pins")
        found.append(now.withColumn("n", F.lit(n)))
    ends = reduce(DataFrame.unionByName, found).join(last, "route").where("b = end")
    return ends.groupBy("route").agg(F.min(F.struct("lost", "n", "pins")).alias("m")).select("route", "m.pins", "m.lost")
