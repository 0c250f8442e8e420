"""Calendars and timetables: service days, fallbacks, bands, feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.operators import transit
from strider.sources.tables import table

ZONE = "America/New_York"


def service_days(spark, d):
    """The service days, and seconds of day, that an event may belong to."""
    e = table(spark, d, "events").select("event_id", F.inline(transit.service_days(F.col("ts").cast("timestamp"), ZONE)))
    return e.select("event_id", "day", F.col("seconds").cast("bigint").alias("seconds"))


def fallback_services(spark, d):
    """The month after the last order takes the services of most of its last six weekdays."""
    o = table(spark, d, "orders")
    runs = o.select(F.to_date("o_orderdate").alias("day"), (F.col("o_custkey") % 40).alias("service")).distinct()
    end = runs.agg(F.max("day").alias("end"))
    days = runs.select("day").distinct().unionByName(end.select(F.explode(F.sequence(F.date_add("end", 1), F.date_add("end", 30))).alias("day")))
    return transit.majority_services(runs, days)


def active_services(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", (F.col("s_suppkey") * 37 % 4).alias("mask"), F.expr("date_add(DATE'1995-01-01', int(s_suppkey % 30))").alias("first"), F.expr("date_add(DATE'1995-02-01', int(s_suppkey % 50))").alias("last"))
    return transit.active_on(s, F.lit("1995-02-20").cast("date")).select("s_suppkey")


def record_on_day(spark, d):
    """The dated record of a supplier that holds a day; an open one has no end."""
    r = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("key"), F.col("l_linenumber").alias("version")).agg(F.to_date(F.min("l_shipdate")).alias("first"), F.when(F.col("l_linenumber") < 5, F.to_date(F.max("l_shipdate"))).alias("last"))
    day = F.lit("1996-06-01").cast("date")
    return r.where(day.between(F.col("first"), F.coalesce("last", day))).select("key", "version")


def feed_union(spark, d):
    """Two feeds as one, their keys told apart by the feed's name."""
    c = table(spark, d, "customer").select(F.concat_ws(":", F.lit("c"), "c_custkey").alias("stop"), F.col("c_nationkey").alias("zone"))
    s = table(spark, d, "supplier").select(F.concat_ws(":", F.lit("s"), "s_suppkey").alias("stop"), F.col("s_nationkey").alias("zone"))
    return c.unionByName(s)


def _calls(spark, d):
    rows = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return rows.select((F.col("l_orderkey") % 50).alias("pattern"), F.col("l_orderkey").alias("trip"), F.col("l_linenumber").alias("seq"), (F.col("l_orderkey") % 900 + F.col("l_linenumber") * 200 + F.col("p") % 450).cast("double").alias("at"))


def pattern_offsets(spark, d):
    return transit.stop_offsets(_calls(spark, d), ["pattern"]).select("pattern", "seq", F.round("offset", 3).alias("offset"))


def headway_bands(spark, d):
    deps = table(spark, d, "orders").select((F.col("o_custkey") % 60).alias("lane"), (F.col("o_orderkey") * 41 % 1440 * 60).cast("int").alias("dep"))
    return transit.headway_bands(deps, ["lane"], "dep")


def merged_bands(spark, d):
    """Each customer's bands of two days, the second a day later."""
    band = lambda start: F.struct(F.lit(start).alias("start"), (F.lit(start) + F.col("c_nationkey") * 60).alias("end"), F.lit(600).alias("headway"))
    lists = F.array(F.struct(F.lit(86_400).alias("offset"), F.array(band(30_000), band(1_000)).alias("bands")), F.struct(F.lit(0).alias("offset"), F.array(band(50_000)).alias("bands")))
    c = table(spark, d, "customer").select("c_custkey", F.posexplode(transit.merged_bands(lists)).alias("i", "b"))
    return c.select("c_custkey", "i", F.col("b.start").alias("start"), F.col("b.end").alias("end"))


def schedule_buckets(spark, d):
    return table(spark, d, "events").select("event_id", transit.schedule_bucket(F.col("value") * 100 - 600).alias("bucket"))


QUERIES = {
    "service_days": service_days, "fallback_services": fallback_services, "active_services": active_services, "record_on_day": record_on_day, "feed_union": feed_union, "pattern_offsets": pattern_offsets,
    "headway_bands": headway_bands, "merged_bands": merged_bands, "schedule_buckets": schedule_buckets,
}

#: New York's clock by rule, in UTC: second Sunday of March 07:00 to first Sunday of November 06:00.
_LOCAL = """loc AS (SELECT event_id, ts + INTERVAL 1 HOUR * (CASE WHEN ts >= make_timestamp(y, 3, 14 - (isodow(make_date(y, 3, 14)) % 7), 7, 0, 0) AND ts < make_timestamp(y, 11, 7 - (isodow(make_date(y, 11, 7)) % 7), 6, 0, 0) THEN -4 ELSE -5 END) AS t
    FROM (SELECT event_id, ts, year(ts) AS y FROM events))"""
ORACLES = {
    "service_days": f"""WITH {_LOCAL} SELECT event_id, CAST(t AS DATE) + CAST(i AS INTEGER) AS day, CAST(hour(t) * 3600 + minute(t) * 60 + second(t) - i * 86400 AS BIGINT) AS seconds FROM loc, (VALUES (-1), (0), (1)) v(i)""",
    "fallback_services": """WITH r AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, o_custkey % 40 AS service FROM orders),
m AS (SELECT max(day) AS e FROM r), d AS (SELECT DISTINCT day FROM r UNION ALL SELECT e + CAST(i AS INTEGER) AS day FROM m, range(1, 31) t(i)),
p AS (SELECT day, k, (SELECT max(x) FROM (SELECT e - CAST(j AS INTEGER) AS x FROM m, range(7) u(j)) WHERE isodow(x) = isodow(day)) - CAST(7 * k AS INTEGER) AS past FROM d, m, range(6) t(k) WHERE day > e),
v AS (SELECT p.day, service, count(*) AS n, min(k) AS k FROM p JOIN r ON r.day = p.past GROUP BY ALL)
SELECT r.day, service FROM r WHERE day IN (SELECT day FROM d) UNION ALL SELECT day, service FROM v WHERE n > 3 OR (n = 3 AND k = 0)""",
    "active_services": """SELECT s_suppkey FROM supplier WHERE s_suppkey * 37 % 4 <> 0 AND DATE '1995-02-20' BETWEEN DATE '1995-01-01' + CAST(s_suppkey % 30 AS INTEGER) AND DATE '1995-02-01' + CAST(s_suppkey % 50 AS INTEGER)""",
    "record_on_day": """WITH r AS (SELECT l_suppkey AS key, l_linenumber AS version, CAST(min(l_shipdate) AS DATE) AS f, CAST(max(l_shipdate) AS DATE) AS l FROM lineitem GROUP BY l_suppkey, l_linenumber)
SELECT key, version FROM r WHERE f <= DATE '1996-06-01' AND (version >= 5 OR l >= DATE '1996-06-01')""",
    "feed_union": "SELECT 'c:' || c_custkey AS stop, c_nationkey AS zone FROM customer UNION ALL SELECT 's:' || s_suppkey, s_nationkey FROM supplier",
    "pattern_offsets": """WITH c AS (SELECT l_orderkey % 50 AS pattern, l_orderkey AS trip, l_linenumber AS seq, CAST(l_orderkey % 900 + l_linenumber * 200 + min(l_partkey) % 450 AS DOUBLE) AS t FROM lineitem GROUP BY l_orderkey, l_linenumber),
s AS (SELECT pattern, seq, t - min(t) OVER (PARTITION BY pattern, trip) AS s FROM c), m AS (SELECT pattern, seq, median(s) AS m FROM s GROUP BY ALL)
SELECT pattern, seq, round(max(m) OVER (PARTITION BY pattern ORDER BY seq ROWS UNBOUNDED PRECEDING), 3) AS "offset" FROM m""",
    "headway_bands": """WITH RECURSIVE t AS (SELECT lane, dep, row_number() OVER (PARTITION BY lane ORDER BY dep) AS i FROM (SELECT DISTINCT o_custkey % 60 AS lane, CAST(o_orderkey * 41 % 1440 * 60 AS INTEGER) AS dep FROM orders)),
f AS (SELECT lane, i, dep AS s, dep AS e, 1 AS n FROM t WHERE i = 1 UNION ALL
    SELECT lane, i, CASE WHEN fits THEN s ELSE dep END, dep, CASE WHEN fits THEN n + 1 ELSE 1 END FROM
    (SELECT f.lane, t.i, s, dep, n, n = 1 OR abs(dep - e - (e - s) / greatest(n - 1, 1)) <= greatest(60.0::DOUBLE, 0.1::DOUBLE * ((e - s) / greatest(n - 1, 1))) AS fits FROM f JOIN t ON t.lane = f.lane AND t.i = f.i + 1)),
b AS (SELECT *, lead(n) OVER (PARTITION BY lane ORDER BY i) AS next FROM f)
SELECT lane, s AS start, e AS "end", CAST(CASE WHEN n > 1 THEN floor((e - s) / (n - 1) + 0.5) ELSE 0 END AS INTEGER) AS headway FROM b WHERE next IS NULL OR next = 1""",
    "merged_bands": """SELECT c_custkey, i, s AS start, s + c_nationkey * 60 AS "end" FROM customer, (VALUES (0, 50000), (1, 87400), (2, 116400)) v(i, s)""",
    "schedule_buckets": "SELECT event_id, CAST(greatest(0, least(48, floor((value * 100 - 600) / 300 + 0.5))) AS INTEGER) AS bucket FROM events",
}
