"""Joins with a rule: fallback keys, as-of, intervals, calendars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(left: DataFrame, right: DataFrame, keys: list[tuple[Column, Column]], value: str, order: list[str], out: str) -> DataFrame:
    """left with out: right's value by the first key pair that finds one (ties by order).

    Each key is reduced to one row on the right before it is joined, so no join multiplies rows."""
    found = left
    names = []
    for i, (lk, rk) in enumerate(keys):
        best = right.select(rk.alias(f"_r{i}"), F.struct(*order, F.col(value).alias("_value")).alias("_o")).groupBy(f"_r{i}").agg(F.min("_o").alias("_o")).select(f"_r{i}", F.col("_o._value").alias(f"_v{i}"))
        found = found.withColumn(f"_l{i}", lk).join(best, F.col(f"_l{i}") == F.col(f"_r{i}"), "left").drop(f"_l{i}", f"_r{i}")
        names.append(f"_v{i}")
    return found.withColumn(out, F.coalesce(*names)).drop(*names)


def asof_forward(left: DataFrame, right: DataFrame, key: str, at: str, then: str, out: str) -> DataFrame:
    """left with out: the first right `then` not before `at` on the same key, or null.

    Both sides go through one sort, latest first: the last right row passed so far is the answer,
    so a key with many rows on either side costs a sort and one pass."""
    a = left.withColumn("_t", F.col(at)).withColumn("_side", F.lit(0)).withColumn("_then", F.lit(None).cast(right.schema[then].dataType))
    b = right.select(F.col(key), F.col(then).alias("_t"), F.lit(1).alias("_side"), F.col(then).alias("_then"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(out, F.last("_then", ignorenulls=True).over(w)).where("_side = 0").drop("_t", "_side", "_then")


def next_in_band(start: Column, end: Column, headway: Column, at: Column) -> Column:
    """The next departure of a band (start, end, headway) at or after a time; null after its last."""
    grid = start + F.ceil((at - start) / headway) * headway
    return F.when(at <= start, start).when(at > end, F.lit(None)).when(headway <= 0, F.lit(None)).otherwise(F.least(grid, end))


def active_services(services: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """day, service: services (service, mask, first, last) that run on days (day).

    Bit 0 of the mask is Monday; exceptions (service, day, kind) add (1) or take (2) a day."""
    # A service's range as days, so that days meet it by equality.
    runs = services.where("first <= last").withColumn("day", F.explode(F.sequence("first", "last")))
    bit = F.shiftright("mask", 0).bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(7)]), F.weekday("day") + 1)) != 0
    regular = runs.where(bit).join(days.select("day").distinct(), "day", "left_semi").select("day", "service")
    named = days.join(exceptions, "day").select("day", "service", "kind")
    off = named.where("kind = 2")
    return regular.join(off, ["day", "service"], "left_anti").unionByName(named.where("kind = 1").select("day", "service")).distinct()


def shared_half(docs: DataFrame, key: str, words: str) -> DataFrame:
    """key, same, links: rows by their sorted distinct words: the smallest key with the same ones,
    and how many other rows share at least half of all words of the two.

    Rows with equal words are one class, so copies cost nothing; classes meet on one of their
    rarer words: two sets with half in common share one of the n - n/2 + 1 rarest of each."""
    classes = docs.where(F.size(words) > 0).groupBy(words).agg(F.min(key).alias("same"), F.count(F.lit(1)).alias("n"))
    each = classes.select("same", "n", F.col(words).alias("t"), F.explode(words).alias("w"))
    often = each.groupBy("w").agg(F.count(F.lit(1)).alias("often"))
    ranked = each.join(often, "w").withColumn("i", F.row_number().over(Window.partitionBy("same").orderBy("often", "w")))
    rare = ranked.where(F.col("i") <= F.size("t") - F.ceil(F.size("t") / 2) + 1).select("w", "same", "n", "t")
    other = rare.select("w", F.col("same").alias("other"), F.col("n").alias("m"), F.col("t").alias("u"))
    pairs = rare.join(other, "w").where("same <> other").select("same", "other", "m", "t", "u").distinct()
    both = F.size(F.array_intersect("t", "u"))
    near = pairs.where(both * 2 >= F.size("t") + F.size("u") - both).groupBy("same").agg(F.sum("m").alias("m"))
    linked = classes.join(near, "same", "left").select(F.col(words).alias("_w"), "same", (F.col("n") - 1 + F.coalesce("m", F.lit(0))).alias("links"))
    return docs.join(linked, F.col(words) == F.col("_w")).select(key, "same", "links")
