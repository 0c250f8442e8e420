"""Window and interval queries over events and orders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strider.operators import windows
from strider.sources.tables import table


def _events(spark, d):
    return table(spark, d, "events").withColumn("at", F.unix_timestamp(F.col("ts").cast("timestamp")))


def event_gaps(spark, d):
    rows = windows.gaps(_events(spark, d).select("user_id", "at").distinct(), ["user_id"], "at")
    return rows.groupBy("user_id").agg(F.max("gap").alias("longest"), F.min("gap").alias("shortest"), F.count("gap").alias("gaps"))


def changes(spark, d):
    return windows.drop_repeats(_events(spark, d), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


def order_runs(spark, d):
    rows = table(spark, d, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return windows.date_runs(rows, ["o_custkey"], "day", 60).select("o_custkey", "first", "last", "days")


def standing_on(spark, d):
    """The run that holds a day, for each customer that has one."""
    return order_runs(spark, d).where(F.lit("1996-06-01").cast("date").between(F.col("first"), F.col("last")))


def merged_spans(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.datediff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date")).cast("double").alias("s"), "l_quantity")
    rows = rows.withColumn("e", F.col("s") + F.col("l_quantity") / 10)
    return windows.merge_spans(rows, ["l_suppkey"], "s", "e", 0.5, 1.0).select("l_suppkey", F.round("start", 4).alias("start"), F.round("end", 4).alias("end"), "parts")


def running_values(spark, d):
    rows = _events(spark, d).select("user_id", "event_id", "ts", "value")
    rows = windows.running_max(rows, ["user_id"], ["ts", "event_id"], "value", "peak")
    return windows.moving_median(rows, ["user_id"], ["ts", "event_id"], "value", 30, "recent").select("user_id", "event_id", "peak", "recent")


def decayed_counts(spark, d):
    rows = _events(spark, d)
    now = F.lit(1_800_000_000)
    return rows.groupBy("user_id", "event_type").agg(F.round(windows.decayed(F.col("at"), now, 30.0 * 86400) * 1e6, 4).alias("weight"), F.max("at").alias("last_seen"))


def line_ordinals(spark, d):
    return windows.ordinals(table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey"], ["l_partkey", "l_linenumber"])


def cumulative_quantity(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.sum("l_quantity").over(w).alias("along"))


def leads(spark, d):
    rows = table(spark, d, "supplier").groupBy("s_nationkey", "s_suppkey").agg(F.max("s_acctbal").alias("score"))
    out = windows.lead_over_rest(rows, ["s_nationkey"], "score")
    return out.select("s_nationkey", "s_suppkey", F.round("lead", 2).alias("lead"))


def climbs(spark, d):
    """Signed rises and falls along an ordered chain; a null breaks it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, d).select("user_id", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("h"), "ts", "event_id")
    step = F.col("h") - F.lag("h").over(w)
    rows = rows.select("user_id", step.alias("step"))
    return rows.groupBy("user_id").agg(F.round(F.sum(F.when(F.col("step") > 0, F.col("step")).otherwise(0.0)), 4).alias("up"), F.round(F.sum(F.when(F.col("step") < 0, -F.col("step")).otherwise(0.0)), 4).alias("down"))


def longest_runs(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, d).select("user_id", "event_id", "ts", "event_type").withColumn("new", F.col("event_type") != F.lag("event_type").over(w))
    runs = windows.islands(rows, ["user_id"], ["ts", "event_id"], F.col("new")).groupBy("user_id", "island", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return runs.groupBy("user_id", "event_type").agg(F.max("n").alias("longest"))


def sessions(spark, d):
    """Visits to one kind of event by a user within ten minutes are one pass."""
    rows = _events(spark, d).groupBy("user_id", "event_type", F.session_window(F.col("ts").cast("timestamp"), "10 minutes").alias("s"))
    out = rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value") - F.min("value"), 4).alias("cover"))
    return out.select("user_id", "event_type", F.unix_timestamp("s.start").alias("start"), "n", "cover")


def within_cap(spark, d):
    """Newest rows of each store until a byte cap; the rest is evicted."""
    w = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id")).rowsBetween(Window.unboundedPreceding, 0)
    rows = _events(spark, d).select("event_type", "event_id", F.sum(F.length("props")).over(w).alias("held"))
    return rows.where("held > 2000").select("event_type", "event_id")


def pareto(spark, d):
    """Parts that no other part of their brand beats in price, size and key order."""
    rows = table(spark, d, "part").select("p_partkey", F.floor("p_retailprice").cast("double").alias("price"), F.col("p_size").cast("double").alias("size"), F.pmod(F.col("p_partkey") * 31, F.lit(97)).cast("double").alias("penalty"))
    return windows.skyline(rows, ["price", "size", "penalty"], "p_partkey").select("p_partkey", "price", "size", "penalty")


QUERIES = {
    "event_gaps": event_gaps, "type_changes": changes, "order_runs": order_runs, "runs_on_a_day": standing_on, "merged_spans": merged_spans, "running_values": running_values,
    "decayed_counts": decayed_counts, "line_ordinals": line_ordinals, "cumulative_quantity": cumulative_quantity, "lead_over_rest": leads, "climbs": climbs, "longest_runs": longest_runs,
    "session_passes": sessions, "evicted_over_cap": within_cap, "pareto_parts": pareto,
}

_RUNS = """
WITH d AS (SELECT DISTINCT o_custkey, CAST(o_orderdate AS DATE) AS day FROM orders),
g AS (SELECT *, CASE WHEN day - lag(day) OVER w <= 60 THEN 0 ELSE 1 END AS new FROM d WINDOW w AS (PARTITION BY o_custkey ORDER BY day)),
i AS (SELECT *, sum(new) OVER (PARTITION BY o_custkey ORDER BY day) AS island FROM g),
r AS (SELECT o_custkey, min(day) AS first, max(day) AS last, count(*) AS days FROM i GROUP BY o_custkey, island)
"""
ORACLES = {
    "event_gaps": """
WITH e AS (SELECT DISTINCT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS t FROM events), g AS (SELECT user_id, t - lag(t) OVER (PARTITION BY user_id ORDER BY t) AS gap FROM e)
SELECT user_id, max(gap) AS longest, min(gap) AS shortest, count(gap) AS gaps FROM g GROUP BY user_id""",
    "type_changes": """
WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) SELECT user_id, event_id, event_type FROM e WHERE b IS NULL OR b <> event_type""",
    "order_runs": _RUNS + "SELECT * FROM r",
    "runs_on_a_day": _RUNS + "SELECT * FROM r WHERE DATE '1996-06-01' BETWEEN first AND last",
    "merged_spans": """
WITH g AS (SELECT l_suppkey, CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS DOUBLE) - 0.5 AS s, CAST(CAST(l_shipdate AS DATE) - DATE '1992-01-01' AS DOUBLE) + l_quantity / 10 + 0.5 AS e FROM lineitem),
n AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1.0 THEN 0 ELSE 1 END AS new FROM g),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_suppkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT l_suppkey, round(min(s), 4) AS start, round(max(e), 4) AS "end", count(*) AS parts FROM i GROUP BY l_suppkey, island""",
    "running_values": """
WITH r AS (SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS peak,
    list_sort(list(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) AS l FROM events)
SELECT user_id, event_id, peak, l[len(l) // 2 + 1] AS recent FROM r""",
    "decayed_counts": """SELECT user_id, event_type, round(sum(pow(2.0, -(1800000000 - floor(epoch(ts))) / 2592000.0)) * 1e6, 4) AS weight, max(CAST(floor(epoch(ts)) AS BIGINT)) AS last_seen FROM events GROUP BY ALL""",
    "line_ordinals": """SELECT l_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber) - 1 AS ordinal FROM lineitem""",
    "cumulative_quantity": """SELECT l_orderkey, l_linenumber, sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS UNBOUNDED PRECEDING) AS along FROM lineitem""",
    "lead_over_rest": """SELECT a.s_nationkey, a.s_suppkey, round(a.s_acctbal - (SELECT max(b.s_acctbal) FROM supplier b WHERE b.s_nationkey = a.s_nationkey AND b.s_suppkey <> a.s_suppkey), 2) AS lead FROM supplier a""",
    "climbs": """
WITH h AS (SELECT user_id, ts, event_id, CASE WHEN event_id % 7 <> 0 THEN value END AS h FROM events), s AS (SELECT user_id, h - lag(h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step FROM h)
SELECT user_id, round(sum(CASE WHEN step > 0 THEN step ELSE 0 END), 4) AS up, round(sum(CASE WHEN step < 0 THEN -step ELSE 0 END), 4) AS down FROM s GROUP BY user_id""",
    "longest_runs": """
WITH n AS (SELECT *, CASE WHEN event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM n),
r AS (SELECT user_id, event_type, count(*) AS n FROM i GROUP BY user_id, island, event_type) SELECT user_id, event_type, max(n) AS longest FROM r GROUP BY ALL""",
    "session_passes": """
WITH n AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT user_id, event_type, CAST(floor(epoch(min(ts))) AS BIGINT) AS start, count(*) AS n, round(max(value) - min(value), 4) AS cover FROM i GROUP BY user_id, event_type, island""",
    "evicted_over_cap": """
WITH h AS (SELECT event_type, event_id, sum(length(props)) OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS held FROM events) SELECT event_type, event_id FROM h WHERE held > 2000""",
    "pareto_parts": """
WITH p AS (SELECT p_partkey, floor(p_retailprice) AS price, CAST(p_size AS DOUBLE) AS size, CAST((p_partkey * 31) % 97 AS DOUBLE) AS penalty FROM part)
SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.price <= a.price AND b.size <= a.size AND b.penalty <= a.penalty
    AND (b.price < a.price OR b.size < a.size OR b.penalty < a.penalty OR b.p_partkey < a.p_partkey))""",
}
