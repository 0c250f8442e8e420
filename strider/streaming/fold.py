"""The permit fold as a stream: every micro-batch closes and opens runs in a versioned table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strider.operators.graph import settled
from strider.operators.permits import LEAST_SHARE, NEIGHBOURS

_RUNS = "job string, first date, last date"
_DAYS = "day date, n long, kept boolean"


class SnapshotFold:
    """foreachBatch target. State is two tables in `folder`, a version for each batch: judged
    days (a row a day) and runs. A batch that is run again writes its version again from the one
    before, so a restart repeats nothing."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, version: int, name: str, ddl: str) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/{version}/{name}")

    def state(self, version: int) -> tuple[DataFrame, DataFrame]:
        return self._read(version, "days", _DAYS), self._read(version, "runs", _RUNS)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        days, runs = self.state(batch_id - 1)
        history = [tuple(r) for r in days.orderBy(F.desc("day")).limit(NEIGHBOURS).collect()][::-1]
        through = history[-1][0] if history else None
        seen = days.where("kept").agg(F.max("day")).first()[0]
        fresh = batch.select("day", "job").distinct()
        if through is not None:
            fresh = fresh.where(F.col("day") > F.lit(through))  # a snapshot that comes late is skipped
        counts = fresh.groupBy("day").count().orderBy("day").collect()
        judged = []
        for day, n in counts:  # a few days a batch
            near = sorted(h[1] for h in history[-NEIGHBOURS:])
            median = near[len(near) // 2] if near else 0
            kept = median == 0 or n >= LEAST_SHARE * median
            history.append((day, n, kept))
            judged.append((day, n, kept))
            if not kept:
                continue
            now = fresh.where(F.col("day") == F.lit(day)).select("job", F.lit(day).alias("now"))
            open_ = runs.where("last IS NULL").join(now, "job", "full_outer")
            closed = open_.where("first IS NOT NULL").select("job", "first", F.when(F.col("now").isNull(), F.lit(seen)).cast("date").alias("last"))
            begun = open_.where("first IS NULL").select("job", F.col("now").alias("first"), F.lit(None).cast("date").alias("last"))
            # Each day reads the runs that the last one left; a batch holds a few days.
            runs, seen = settled(runs.where("last IS NOT NULL").unionByName(closed).unionByName(begun)), day
        runs.write.mode("overwrite").parquet(f"{self.folder}/{batch_id}/runs")
        days.unionByName(self.spark.createDataFrame(judged, _DAYS)).coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch_id}/days")


def passes(fixes: DataFrame, late: str = "10 minutes") -> DataFrame:
    """user, street, start, cover: sessions of good fixes (user, street, at, along, accuracy_m,
    speed_mps) on a street, ten minutes apart at most; batch or stream (late rows after the
    watermark are dropped and their state with them)."""
    good = fixes.where((F.col("accuracy_m") <= 30) & (F.coalesce("speed_mps", F.lit(0.0)) <= 3))
    if fixes.isStreaming:
        good = good.withWatermark("at", late)
    out = good.groupBy("user", "street", F.session_window("at", "10 minutes").alias("s")).agg((F.max("along") - F.min("along")).alias("cover"))
    return out.select("user", "street", F.col("s.start").alias("start"), "cover")


def decayed_weights(sightings: DataFrame, half_life_s: float = 30 * 86400.0) -> DataFrame:
    """key, weight, at: a stream of (key, at) folded into one decaying weight for each key.

    State is a pair of numbers; the result is the closed form, whatever the batches."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    def step(key, frames, state):
        weight, last = state.get if state.exists else (0.0, None)
        for p in frames:
            for t in sorted(p["at"]):
                s = pd.Timestamp(t).timestamp()
                weight = weight * 2.0 ** (-max(0.0, s - last) / half_life_s) + 1 if last is not None else 1.0
                last = max(s, last) if last is not None else s
        state.update((weight, last))
        yield pd.DataFrame({"key": [key[0]], "weight": [weight], "at": [last]})

    return sightings.groupBy("key").applyInPandasWithState(step, "key string, weight double, at double", "weight double, last double", "update", GroupStateTimeout.NoTimeout)

