"""Timetables: departures to headway bands, segments to medians, patterns to offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed: how far a gap may be from its band's mean.
TOLERANCE_S, TOLERANCE_SHARE = 60, 0.1


def headway_bands(departures: DataFrame, keys: list[str], at: str) -> DataFrame:
    """keys, start, end, headway: the distinct departures of a lane and service as bands.

    A band takes the next departure while its gap is within TOLERANCE_S seconds, or a share of
    TOLERANCE_SHARE, of the band's mean gap so far; a band of one takes any. A lane's day has at
    most 86 400 seconds, so its sorted times are a bounded array, and the bands a fold over it."""
    bands = "array<struct<start:int,end:int,n:int>>"
    band = lambda start, end, n: F.struct(start.alias("start"), end.alias("end"), n.cast("int").alias("n"))

    def take(out: Column, t: Column) -> Column:
        last = F.element_at(out, -1)
        mean = (last["end"] - last["start"]) / (last["n"] - 1)
        fits = (last["n"] == 1) | (F.abs(t - last["end"] - mean) <= F.greatest(F.lit(float(TOLERANCE_S)), mean * TOLERANCE_SHARE))
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(band(last["start"], t, last["n"] + 1)))
        return F.when(fits, longer).otherwise(F.concat(out, F.array(band(t, t, F.lit(1)))))

    lanes = departures.where(F.col(at).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_set(F.col(at).cast("int"))).alias("_t"))
    first = F.array(band(F.get("_t", F.lit(0)), F.get("_t", F.lit(0)), F.lit(1))).cast(bands)
    cut = F.aggregate(F.slice("_t", 2, F.size("_t")), first, lambda out, t: take(out, t).cast(bands))
    rows = lanes.select(*keys, F.inline(cut))
    gap = F.floor((F.col("end") - F.col("start")) / (F.col("n") - 1) + 0.5)
    return rows.select(*keys, "start", "end", F.when(F.col("n") > 1, gap).otherwise(0).cast("int").alias("headway"))


def segments(stop_times: DataFrame) -> DataFrame:
    """a, b, crossing_s, headway_s, route of consecutive stops: stop_times (trip, route, seq, stop, dep).

    The crossing is the median; half the median gap between departures, at most ten minutes, is
    the wait; the route is the most frequent one, the smaller of equals."""
    from pyspark.sql import Window

    w = Window.partitionBy("trip").orderBy("seq")
    hops = stop_times.withColumn("b", F.lead("stop").over(w)).withColumn("arr", F.lead("dep").over(w)).where("b IS NOT NULL AND b <> stop")
    hops = hops.select("route", F.col("stop").alias("a"), "b", "dep", (F.col("arr") - F.col("dep")).alias("s"))
    gap = F.col("dep") - F.lag("dep").over(Window.partitionBy("a", "b").orderBy("dep"))
    waits = hops.select("a", "b", "dep").distinct().withColumn("gap", gap).groupBy("a", "b").agg(F.percentile("gap", F.lit(0.5)).alias("gap"))
    routes = hops.groupBy("a", "b", "route").count().groupBy("a", "b").agg(F.min_by("route", F.struct(-F.col("count"), F.col("route"))).alias("route"))
    times = hops.groupBy("a", "b").agg(F.percentile("s", F.lit(0.5)).alias("crossing_s"))
    return times.join(waits, ["a", "b"]).join(routes, ["a", "b"]).select("a", "b", "crossing_s", F.least(F.col("gap") / 2, F.lit(600.0)).alias("wait_s"), "route")


def stop_offsets(calls: DataFrame, keys: list[str]) -> DataFrame:
    """keys, seq, offset: of calls (keys, trip, seq, at) the median time from each trip's start at
    each stop, never before that of an earlier stop."""
    from pyspark.sql import Window

    since = F.col("at") - F.min("at").over(Window.partitionBy(*keys, "trip"))
    medians = calls.withColumn("s", since).groupBy(*keys, "seq").agg(F.percentile("s", F.lit(0.5)).alias("m"))
    run = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return medians.select(*keys, "seq", F.max("m").over(run).alias("offset"))


def active_on(services: DataFrame, day: Column) -> DataFrame:
    """Services (first, last, mask) that run at all and whose range holds a day."""
    return services.where((F.col("first") <= day) & (day <= F.col("last")) & (F.col("mask") != 0))


def service_days(at: Column, zone: str) -> Column:
    """The three service days that may hold an instant (UTC): yesterday's, today's and tomorrow's
    in a zone, with the seconds since that day's midnight (over 86 400 for yesterday's)."""
    local = F.from_utc_timestamp(at, zone)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    return F.transform(F.array(*[F.lit(i) for i in (-1, 0, 1)]), lambda i: F.struct(F.date_add(F.to_date(local), i).alias("day"), (seconds - i * 86400).alias("seconds")))


def majority_services(runs: DataFrame, days: DataFrame, weeks: int = 6) -> DataFrame:
    """day, service: days (day) beyond a feed's end take the services that ran on most of the
    last `weeks` same weekdays of runs (day, service); at half of them the latest decides."""
    end = runs.agg(F.max("day")).first()[0]
    if end is None:
        return days.join(runs, "day").select("day", "service")
    last = F.date_add(F.lit(end), -F.pmod(F.datediff(F.lit(end), F.col("day")), F.lit(7)))
    looked = days.where(F.col("day") > end).select("day", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(weeks - 1)), lambda i: F.date_add(last, -7 * i))).alias("back", "past"))
    voted = looked.join(runs.select(F.col("day").alias("past"), "service").distinct(), "past").groupBy("day", "service").agg(F.count(F.lit(1)).alias("n"), F.min("back").alias("nearest"))
    won = voted.where((F.col("n") * 2 > weeks) | (F.col("n") * 2 == weeks) & (F.col("nearest") == 0)).select("day", "service")
    return days.where(F.col("day") <= end).join(runs, "day").select("day", "service").distinct().unionByName(won)


def merged_bands(lists: Column) -> Column:
    """Arrays of (offset, bands) as one array of bands (start, end, headway), moved and sorted."""
    moved = F.transform(lists, lambda x: F.transform(x["bands"], lambda b: F.struct((b["start"] + x["offset"]).alias("start"), (b["end"] + x["offset"]).alias("end"), b["headway"].alias("headway"))))
    return F.array_sort(F.flatten(moved))


def schedule_bucket(elapsed: Column, width: int = 300, most: int = 48) -> Column:
    """The bucket of a time since departure, to the nearest, within a horizon of `most` buckets."""
    return F.greatest(F.lit(0), F.least(F.floor(elapsed / width + 0.5).cast("int"), F.lit(most)))
