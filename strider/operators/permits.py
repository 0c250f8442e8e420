"""Dated snapshots of open permits, folded into runs of days."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strider.operators import windows

#: Fixed: how many judged days a snapshot is compared with, and the least share of their median.
NEIGHBOURS, LEAST_SHARE, MERGE_DAYS = 30, 0.75, 14


def judged_days(snapshots: DataFrame) -> DataFrame:
    """day, n, kept: a day counts unless it lists under 3/4 of the median of the 30 days before
    it (rejected days among them). One row a day, so the window over all days is small."""
    days = snapshots.groupBy("day").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(0))
    days = windows.moving_median(days, ["_all"], ["day"], "n", NEIGHBOURS, "median").drop("_all")
    return days.select("day", "n", ((F.coalesce("median", F.lit(0)) == 0) | (F.col("n") >= LEAST_SHARE * F.col("median"))).alias("kept"))


def permit_runs(snapshots: DataFrame) -> DataFrame:
    """job, first, last of each stretch of kept days that list a job (day, job); last is null
    while the latest kept day still lists it."""
    kept = judged_days(snapshots).where("kept").select("day", F.row_number().over(Window.orderBy("day")).alias("i"))
    final = kept.agg(F.max("i").alias("final"))
    rows = snapshots.select("job", "day").distinct().join(F.broadcast(kept), "day")
    w = Window.partitionBy("job").orderBy("i")
    rows = rows.withColumn("_run", F.col("i") - F.row_number().over(w))
    runs = rows.groupBy("job", "_run").agg(F.min("day").alias("first"), F.max("day").alias("until"), F.max("i").alias("at"))
    return runs.join(F.broadcast(final), F.lit(True), "cross").select("job", "first", F.when(F.col("at") < F.col("final"), F.col("until")).alias("last"))


def standing(runs: DataFrame, day: str, seen: str) -> DataFrame:
    """job, first, last of the stretch that holds a day: runs with gaps up to 14 days are one,
    and an open one lasts until the day last seen."""
    shut = runs.select("job", F.col("first").alias("f"), F.coalesce("last", F.lit(seen).cast("date")).alias("l"))
    reach = F.max("l").over(Window.partitionBy("job").orderBy("f").rowsBetween(Window.unboundedPreceding, -1))
    rows = shut.withColumn("_far", F.datediff("f", reach) > MERGE_DAYS)
    out = windows.islands(rows, ["job"], ["f"], F.col("_far")).groupBy("job", "island").agg(F.min("f").alias("first"), F.max("l").alias("last")).drop("island")
    return out.where(F.lit(day).cast("date").between(F.col("first"), F.col("last")))


ADDRESS = ["bin", "house", "street", "first_permit"]


def recovered(garbled: DataFrame, listed: DataFrame, records: DataFrame) -> DataFrame:
    """row, day, job: garbled rows (row, day, bin, house, street, first_permit), whose job number is lost, that are the one
    permit (of records: job and the same address) at their address that the day does not list (listed: day, job).

    Of several rows of one address the first (by row) takes it; addresses with no or several such permits recover nothing.
    Nulls in an address match each other."""
    same = F.lit(True)
    for c in ADDRESS:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    sought = garbled.groupBy("day", *ADDRESS).agg(F.min("row").alias("row"))
    found = sought.join(records.select("job", *[F.col(c).alias(f"_{c}") for c in ADDRESS]), same)
    found = found.join(listed.select("day", "job").distinct(), ["day", "job"], "left_anti")
    return found.groupBy("row", "day").agg(F.min("job").alias("job"), F.count(F.lit(1)).alias("n")).where("n = 1").select("row", "day", "job")


def moved(rows: DataFrame) -> DataFrame:
    """job, day of the snapshots rows (job, day, bin, street, bbl, lat, lng, feet) at which what a placement rests on differs
    from the row before; a job's first row counts as moved. A blank bbl keeps the last one that was stated."""
    w = Window.partitionBy("job").orderBy("day")
    inputs = ["bin", "street", "bbl", "lat", "lng", "feet"]
    stated = rows.withColumn("bbl", F.last(F.nullif("bbl", F.lit("")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    changed = F.lag("day").over(w).isNull()
    for c in inputs:
        changed = changed | ~F.col(c).eqNullSafe(F.lag(c).over(w))
    return stated.withColumn("_moved", changed).where("_moved").select("job", "day")
