"""Ordered analytics: gaps, islands, merged spans, running and moving values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, keys: list[str], at: str, out: str = "gap") -> DataFrame:
    """The distance of each row to the one before it in its group."""
    return df.withColumn(out, F.col(at) - F.lag(at).over(Window.partitionBy(*keys).orderBy(at)))


def drop_repeats(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_before", F.lag(value).over(w)).where(~F.col(value).eqNullSafe(F.col("_before")) | F.col("_before").isNull()).drop("_before")


def islands(df: DataFrame, keys: list[str], order: list[str], starts: Column, out: str = "island") -> DataFrame:
    """Numbers runs of rows: `starts` is true where a new run begins (null: the first row)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_new", F.coalesce(starts.cast("int"), F.lit(1))).withColumn(out, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def date_runs(df: DataFrame, keys: list[str], day: str, most_gap: int) -> DataFrame:
    """keys, first, last, days: dates joined into runs where gaps are at most most_gap days."""
    days = df.select(*keys, F.col(day).alias("_d")).distinct()
    w = Window.partitionBy(*keys).orderBy("_d")
    far = F.datediff("_d", F.lag("_d").over(w)) > most_gap
    return islands(days.withColumn("_far", far), keys, ["_d"], F.col("_far")).groupBy(*keys, "island").agg(F.min("_d").alias("first"), F.max("_d").alias("last"), F.count(F.lit(1)).alias("days")).drop("island")


def merge_spans(df: DataFrame, keys: list[str], start: str, end: str, grow: float = 0.0, join_gap: float = 0.0) -> DataFrame:
    """keys, start, end of spans merged where they, grown, overlap or come within join_gap."""
    grown = df.select(*keys, (F.col(start) - grow).alias("_s"), (F.col(end) + grow).alias("_e"))
    w = Window.partitionBy(*keys).orderBy("_s", "_e")
    reach = F.max("_e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = grown.withColumn("_apart", F.col("_s") > reach + join_gap)
    return islands(rows, keys, ["_s", "_e"], F.col("_apart")).groupBy(*keys, "island").agg(F.min("_s").alias("start"), F.max("_e").alias("end"), F.count(F.lit(1)).alias("parts")).drop("island")


def running_max(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    return df.withColumn(out, F.max(value).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))


def moving_median(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int, out: str) -> DataFrame:
    """The upper median of the `rows` rows before; null for the first row. A frame is bounded."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, -1)
    near = F.array_sort(F.collect_list(value).over(w))
    return df.withColumn("_near", near).withColumn(out, F.get("_near", F.floor(F.size("_near") / 2).cast("int"))).drop("_near")


def decayed(at: Column, now: Column, half_life: float) -> Column:
    """The sum of one for each row, halved every half_life (same unit as now - at)."""
    return F.sum(F.pow(F.lit(2.0), -(now - at) / F.lit(half_life)))


def ordinals(df: DataFrame, keys: list[str], order: list[str], out: str = "ordinal") -> DataFrame:
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)


def lead_over_rest(df: DataFrame, keys: list[str], value: str, out: str = "lead") -> DataFrame:
    """How far a row is above the best other row of its group (null without another)."""
    w = Window.partitionBy(*keys)
    first, second = F.max(value).over(w), F.nth_value(value, 2).over(w.orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return df.withColumn(out, F.when(F.count(F.lit(1)).over(w) > 1, F.col(value) - F.when(F.col(value) == first, second).otherwise(first)))


def skyline(df: DataFrame, better_low: list[str], order: str, fan_in: int = 8) -> DataFrame:
    """Rows that no other dominates (at most as large in every column, smaller in one; of equal
    rows the earliest stands). Rows with a null or NaN in a column are left out.

    Each partition is sorted by the columns' sum, so that no row is dominated by a later one, and
    thinned in one pass against the rows that stand so far. What is left of `fan_in` partitions
    meets in one, round by round: the skyline of the parts' skylines is that of the whole."""
    import numpy as np

    def thin(batches):
        stand = np.zeros((0, len(better_low)))
        for p in batches:
            x, keep = p[better_low].to_numpy(float), []
            for i, row in enumerate(x):
                if not (stand <= row).all(axis=1).any():
                    stand = np.vstack([stand, row])
                    keep.append(i)
            yield p.iloc[keep]

    finite = [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in better_low]
    rows, total = df, F.lit(0.0)
    for c, ok in zip(better_low, finite):
        rows, total = rows.where(ok), total + F.col(c).cast("double")
    tasks = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = rows.repartition(tasks, order)
    while True:
        rows = rows.sortWithinPartitions(total, *better_low, order).mapInPandas(thin, df.schema)
        if tasks == 1:
            return rows
        tasks = -(-tasks // fan_in)
        rows = rows.repartition(tasks)


def merged_legs(steps: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, leg, first, last, seconds: consecutive steps of one line without a wait between them
    (columns line, wait, seconds) are one leg."""
    w = Window.partitionBy(*keys).orderBy(order)
    new = F.when((F.lag("line").over(w) == F.col("line")) & (F.col("wait") == 0), 0).otherwise(1)
    legs = steps.withColumn("_new", new).withColumn("leg", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return legs.groupBy(*keys, "leg").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.sum(F.col("wait") + F.col("seconds")).alias("seconds"))
