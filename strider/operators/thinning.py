"""Ordered greedy thinning: of points of one name a point stays unless one that stays before it is near."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.operators.stored import stored


def greedy_apart(points: DataFrame, name: str, order: list[str], reach: float) -> DataFrame:
    """The points (name, x, y and order, which tells rows of a name apart) that stay when each is taken in order
    and stays if no staying one of its name is within reach.

    Rounds: points of a cell whose diagonal is the reach are all near each other, so only the first of a cell can
    stay next. It does if no undecided point before it in the cells around is near; then those near it go. A round
    compares points with at most 25 such firsts, not with each other; the first of every name is decided in every
    round, so rounds end, in practice after a few. A null name is no name: such points stay."""
    side = reach / math.sqrt(2) * (1 - 1e-9)
    key = F.struct(*order)
    rows = points.where(F.col(name).isNotNull()).select(F.col(name).alias("_name"), key.alias("_key"), F.col("x").alias("_x"), F.col("y").alias("_y"))
    rows = rows.withColumn("_cx", F.floor(F.col("_x") / side)).withColumn("_cy", F.floor(F.col("_y") / side))
    left, kept = stored(rows), []
    around = F.sequence(F.lit(-2), F.lit(2))
    near = (F.col("_x") - F.col("fx")) * (F.col("_x") - F.col("fx")) + (F.col("_y") - F.col("fy")) * (F.col("_y") - F.col("fy")) <= reach * reach
    on = (F.col("_name") == F.col("fname")) & (F.col("_cx") == F.col("gx")) & (F.col("_cy") == F.col("gy"))

    def spread(firsts: DataFrame) -> DataFrame:
        out = firsts.withColumn("_dx", F.explode(around)).withColumn("_dy", F.explode(around))
        return out.withColumn("gx", F.col("cx") + F.col("_dx")).withColumn("gy", F.col("cy") + F.col("_dy")).drop("_dx", "_dy", "cx", "cy")

    while not left.isEmpty():
        firsts = left.groupBy("_name", "_cx", "_cy").agg(F.min(F.struct("_key", "_x", "_y")).alias("m"))
        firsts = firsts.select(F.col("_name").alias("fname"), F.col("_cx").alias("cx"), F.col("_cy").alias("cy"), F.col("m._key").alias("fkey"), F.col("m._x").alias("fx"), F.col("m._y").alias("fy"))
        firsts = stored(firsts)
        waits = left.join(spread(firsts), on & (F.col("_key") < F.col("fkey")) & near).select("fname", "fkey").distinct()
        stay = stored(firsts.join(waits, ["fname", "fkey"], "left_anti").select(firsts.columns))
        kept.append(stay.select("fname", "fkey"))
        left = stored(left.join(spread(stay), on & near, "left_anti"))
    unnamed = points.where(F.col(name).isNull())
    if not kept:
        return unnamed
    staying = reduce(DataFrame.unionByName, kept)
    return unnamed.unionByName(points.join(staying, (F.col(name) == F.col("fname")) & (key == F.col("fkey")), "left_semi"))
