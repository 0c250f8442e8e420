"""Shapes of lines: more vertices, fewer vertices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.functions import geo
from strider.operators.lines import pieces
from strider.operators.stored import stored


def densified(vertices: DataFrame, most: float = 25.0) -> DataFrame:
    """line, i, k, x, y: the vertices (line, i, x, y) and, within each piece, as many evenly spaced points (k from 1) as
    keep neighbours at most `most` metres apart. The last vertex of a line is one of its own."""
    p = pieces(vertices)
    n = F.greatest(F.lit(1), F.ceil(F.col("meters") / most)).cast("int")
    p = p.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("k") / F.col("n")
    inner = p.select("line", "i", "k", (F.col("ax") + t * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + t * (F.col("by") - F.col("ay"))).alias("y"))
    last = vertices.groupBy("line").agg(F.max_by(F.struct("i", "x", "y"), "i").alias("m")).select("line", "m.i", F.lit(0).alias("k"), "m.x", "m.y")
    return inner.unionByName(last)


def simplified(vertices: DataFrame, tolerance: float) -> DataFrame:
    """The vertices (line, i, x, y) that stay when a line is told within `tolerance` metres: its ends, and between two that
    stay the one farthest from their chord (the first of equals), if it is farther than that.

    Rounds split all open chords at once: each is one join with the vertices still between their ends, so a very long
    line is the work of many tasks, and rounds are as many as splits are deep."""
    w = Window.partitionBy("line")
    v = vertices.select("line", "i", "x", "y").withColumn("lo", F.min("i").over(w)).withColumn("hi", F.max("i").over(w))
    ends = v.where("i = lo OR i = hi").select("line", "i")
    place = vertices.select(F.col("line").alias("l"), F.col("i").alias("j"), "x", "y")
    kept, left = [ends], v.where("lo < i AND i < hi")
    at = lambda c, n: place.select(F.col("l").alias("line"), F.col("j").alias(c), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    while True:
        off = geo.segment_distance(*[F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")])
        chords = left.select("line", "lo", "hi").distinct().join(at("lo", "a"), ["line", "lo"]).join(at("hi", "b"), ["line", "hi"])
        far = left.join(chords, ["line", "lo", "hi"]).groupBy("line", "lo", "hi").agg(F.min(F.struct((-off).alias("off"), "i")).alias("m"))
        far = stored(far.where(-F.col("m.off") > tolerance).select("line", "lo", "hi", F.col("m.i").alias("split")))
        if far.isEmpty():
            return vertices.join(reduce(DataFrame.unionByName, kept).distinct(), ["line", "i"], "left_semi")
        kept.append(far.select("line", F.col("split").alias("i")))
        left = left.join(far, ["line", "lo", "hi"]).where("i <> split")
        before = F.col("i") < F.col("split")
        left = stored(left.select("line", "i", "x", "y", F.when(before, F.col("lo")).otherwise(F.col("split")).alias("lo"), F.when(before, F.col("split")).otherwise(F.col("hi")).alias("hi")))
