"""Grouped statistics over the star schema."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strider.operators import stats
from strider.sources.tables import table

#: The reference's fronting rule (commercial.rs:31-38). The gate picks blocks after every lot is counted.
MIN_LOTS, GATE_SHARE, GATE_HEIGHT = 4, 0.5, 25


def fronting_signals(spark, d):
    """Per block (a part's brand): share of commercial lots, upper median height, flags; every block that passes the gate, ranked."""
    lots = (
        table(spark, d, "lineitem").select("l_partkey", "l_orderkey", "l_returnflag")
        .join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("block"), F.col("p_size").alias("height")), "l_partkey")
        .join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.expr("shiftleft(1, int(substring(o_orderpriority, 1, 1)))").alias("flag")), "l_orderkey")
    )
    # One pass over the joined rows: counts by (block, height) give shares, flags and the median.
    by_height = lots.groupBy("block", "height").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("l_returnflag") != "N", 1).otherwise(0)).alias("hits"), F.expr("bit_or(flag)").alias("flag"))
    w = Window.partitionBy("block")
    run = by_height.withColumn("run", F.sum("n").over(w.orderBy("height").rowsBetween(Window.unboundedPreceding, 0))).withColumn("lots", F.sum("n").over(w))
    middle = F.floor(F.col("lots") / 2) + 1
    gated = run.groupBy("block", "lots").agg(F.sum("hits").alias("hits"), F.expr("bit_or(flag)").cast("int").alias("flags"), F.max(F.when((F.col("run") - F.col("n") < middle) & (middle <= F.col("run")), F.col("height"))).alias("height"))
    gated = gated.withColumn("share", F.round(F.when(F.col("lots") >= MIN_LOTS, F.col("hits") / F.col("lots")).otherwise(0.0), 6))
    gated = gated.where((F.col("share") >= GATE_SHARE) & (F.col("height") <= GATE_HEIGHT) & (F.col("flags").bitwiseAND(6) != 0))
    return gated.select("block", "lots", "share", "height", "flags").orderBy(F.desc("share"), "block")


def medians(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_quantity")
    upper = stats.upper_median(rows, ["l_suppkey"], "l_quantity", "upper_median")
    both = rows.groupBy("l_suppkey").agg(stats.mean_median("l_quantity").alias("mean_median"))
    return both.join(upper, "l_suppkey").select("l_suppkey", "mean_median", F.floor(F.col("mean_median") + 0.5).cast("long").alias("rounded_median"), "upper_median")


def quantiles(spark, d):
    rows = table(spark, d, "orders").select("o_orderpriority", "o_totalprice")
    nearest = rows.groupBy("o_orderpriority").agg(*[stats.nearest_rank("o_totalprice", q).alias(f"p{int(q * 100)}") for q in (0.5, 0.9, 0.99)], F.min("o_totalprice").alias("least"), F.max("o_totalprice").alias("most"))
    index = stats.rounded_index(rows, ["o_orderpriority"], "o_totalprice", {"i25": 0.25, "i75": 0.75})
    return nearest.join(index, "o_orderpriority")


def weighted_medians(spark, d):
    rows = table(spark, d, "lineitem").withColumn("tie", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    half = stats.weighted_median(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", "tie")
    most = stats.weighted_quantile(rows, ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", 0.9, "tie", "p90")
    return half.join(most, ["l_returnflag", "l_linestatus"])


def modes(spark, d):
    return stats.first_seen_mode(table(spark, d, "events"), ["user_id"], "event_type", "event_id")


def axes(spark, d):
    rows = table(spark, d, "lineitem").select("l_suppkey", F.radians(F.pmod(F.col("l_partkey") * 37, F.lit(360)).cast("double")).alias("b"), "l_quantity")
    return rows.groupBy("l_suppkey").agg(F.round(stats.axis_mean(F.col("b"), F.col("l_quantity")), 6).alias("axis"))


def composites(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_discount", "l_quantity")
    return rows.groupBy("l_orderkey").agg(
        F.round(stats.any_of(F.col("l_discount")), 10).alias("any_discount"),
        F.round(stats.saturated(F.sum(F.exp(-F.pow(F.col("l_quantity") / 40.0, F.lit(2)))), 0.7), 6).alias("amenity"),
        F.round(F.least(F.lit(1.0), F.sum(F.col("l_quantity") / 100.0)), 6).alias("cover"),
        F.round(F.sum(F.when(F.col("l_discount") > 0, F.col("l_quantity") * F.col("l_discount"))) / F.sum(F.when(F.col("l_discount") > 0, F.col("l_quantity"))), 10).alias("depth"),
    )


def top_kinds(spark, d):
    labelled = stats.top_or_other(table(spark, d, "part").select("p_type", "p_retailprice"), "p_type", 3)
    return labelled.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("p_retailprice"), 2).alias("price"))


def histogram(spark, d):
    """Counts over unequal edges."""
    q = F.col("l_quantity")
    bucket = F.when(q < 5, 0).when(q < 12, 1).when(q < 20, 2).when(q < 35, 3).otherwise(4)
    return table(spark, d, "lineitem").groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def direction_shares(spark, d):
    """Patterns (ship year and flag) with 2 % of their direction's trips or more, and whether the busiest."""
    from pyspark.sql import Window

    n = table(spark, d, "lineitem").groupBy("l_linestatus", F.month("l_shipdate").alias("pattern")).agg(F.count(F.lit(1)).alias("trips"))
    w = Window.partitionBy("l_linestatus")
    rows = n.select("l_linestatus", "pattern", "trips", F.round(F.col("trips") / F.sum("trips").over(w), 6).alias("share"), (F.col("trips") == F.max("trips").over(w)).alias("busiest"))
    return rows.where((F.col("share") >= 0.02) | F.col("busiest"))


def rollups(spark, d):
    rows = table(spark, d, "orders").withColumn("year", F.year("o_orderdate"))
    out = rows.cube("year", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"), F.grouping_id().cast("long").alias("gid"))
    return out.select("year", "o_orderstatus", "n", "price", "gid")


def pivoted(spark, d):
    rows = table(spark, d, "events").groupBy("user_id").pivot("event_type", ["click", "purchase", "view"]).agg(F.count(F.lit(1)))
    return rows.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "purchase", "view")])


def component_totals(spark, d):
    """Totals by group and the main group (largest, then smallest key)."""
    n = table(spark, d, "customer").groupBy("c_nationkey").agg(F.round(F.sum("c_acctbal"), 2).alias("total"))
    main = n.agg(F.min_by("c_nationkey", F.struct(-F.col("total"), F.col("c_nationkey"))).alias("main"))
    return n.join(F.broadcast(main), F.lit(True), "cross").select("c_nationkey", "total", (F.col("c_nationkey") == F.col("main")).alias("is_main"))


QUERIES = {
    "fronting_signals": fronting_signals, "medians": medians, "quantiles": quantiles, "weighted_medians": weighted_medians, "first_seen_modes": modes, "axis_means": axes,
    "composites": composites, "top_kinds": top_kinds, "unequal_histogram": histogram, "direction_shares": direction_shares, "cube_totals": rollups, "pivoted_events": pivoted, "main_group": component_totals,
}

ORACLES = {
    "fronting_signals": """
WITH lots AS (SELECT p_brand AS block, p_size AS height, l_returnflag, 1 << CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS flag
    FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey),
s AS (SELECT block, count(*) AS lots, round(CASE WHEN count(*) >= 4 THEN count(*) FILTER (WHERE l_returnflag <> 'N') / count(*) ELSE 0 END, 6) AS share,
    list_sort(list(height))[count(*) // 2 + 1] AS height, CAST(bit_or(flag) AS INTEGER) AS flags FROM lots GROUP BY block)
SELECT * FROM s WHERE share >= 0.5 AND height <= 25 AND (flags & 6) <> 0 ORDER BY share DESC, block""",
    "medians": """SELECT l_suppkey, median(l_quantity) AS mean_median, CAST(floor(median(l_quantity) + 0.5) AS BIGINT) AS rounded_median,
    list_sort(list(l_quantity))[count(*) // 2 + 1] AS upper_median FROM lineitem GROUP BY l_suppkey""",
    "quantiles": """SELECT o_orderpriority, quantile_disc(o_totalprice, 0.5) AS p50, quantile_disc(o_totalprice, 0.9) AS p90, quantile_disc(o_totalprice, 0.99) AS p99,
    min(o_totalprice) AS least, max(o_totalprice) AS most,
    list_sort(list(o_totalprice))[CAST(floor(0.25 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS i25,
    list_sort(list(o_totalprice))[CAST(floor(0.75 * (count(*) - 1) + 0.5) AS BIGINT) + 1] AS i75 FROM orders GROUP BY o_orderpriority""",
    "weighted_medians": """
WITH r AS (SELECT l_returnflag, l_linestatus, l_quantity AS v, sum(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_quantity, l_orderkey, l_linenumber
    ROWS UNBOUNDED PRECEDING) AS run, sum(l_extendedprice) OVER (PARTITION BY l_returnflag, l_linestatus) AS total FROM lineitem)
SELECT l_returnflag, l_linestatus, min(v) FILTER (WHERE run * 2 >= total) AS median, min(v) FILTER (WHERE run >= total * 0.9) AS p90 FROM r GROUP BY ALL""",
    "first_seen_modes": """
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY ALL)
SELECT user_id, arg_min(event_type, (-n, f)) AS mode, max(n) AS votes FROM c GROUP BY user_id""",
    "axis_means": """SELECT l_suppkey, round(atan2(sum(l_quantity * sin(2 * radians(CAST((l_partkey * 37) % 360 AS DOUBLE)))), sum(l_quantity * cos(2 * radians(CAST((l_partkey * 37) % 360 AS DOUBLE))))) / 2, 6) AS axis
    FROM lineitem GROUP BY l_suppkey""",
    "composites": """SELECT l_orderkey, round(1 - exp(sum(ln(1 - l_discount))), 10) AS any_discount, round(1 - exp(-0.7 * sum(exp(-pow(l_quantity / 40.0, 2)))), 6) AS amenity,
    round(least(1.0, sum(l_quantity / 100.0)), 6) AS cover,
    round(sum(CASE WHEN l_discount > 0 THEN l_quantity * l_discount END) / sum(CASE WHEN l_discount > 0 THEN l_quantity END), 10) AS depth
    FROM lineitem GROUP BY l_orderkey""",
    "top_kinds": """
WITH t AS (SELECT p_type FROM part GROUP BY p_type ORDER BY count(*) DESC, p_type LIMIT 3)
SELECT coalesce(t.p_type, 'Other') AS label, count(*) AS n, round(sum(p_retailprice), 2) AS price FROM part LEFT JOIN t ON part.p_type = t.p_type GROUP BY 1""",
    "unequal_histogram": """SELECT CASE WHEN l_quantity < 5 THEN 0 WHEN l_quantity < 12 THEN 1 WHEN l_quantity < 20 THEN 2 WHEN l_quantity < 35 THEN 3 ELSE 4 END AS bucket, count(*) AS n FROM lineitem GROUP BY 1""",
    "direction_shares": """
WITH n AS (SELECT l_linestatus, CAST(month(l_shipdate) AS INTEGER) AS pattern, count(*) AS trips FROM lineitem GROUP BY ALL),
s AS (SELECT *, round(trips / sum(trips) OVER (PARTITION BY l_linestatus), 6) AS share, trips = max(trips) OVER (PARTITION BY l_linestatus) AS busiest FROM n)
SELECT * FROM s WHERE share >= 0.02 OR busiest""",
    "cube_totals": """SELECT CAST(year(o_orderdate) AS INTEGER) AS year, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price, CAST(grouping(year(o_orderdate), o_orderstatus) AS BIGINT) AS gid
    FROM orders GROUP BY CUBE (year(o_orderdate), o_orderstatus)""",
    "pivoted_events": """SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'purchase') AS purchase, count(*) FILTER (WHERE event_type = 'view') AS view
    FROM events GROUP BY user_id""",
    "main_group": """
WITH n AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1)
SELECT c_nationkey, total, c_nationkey = (SELECT c_nationkey FROM n ORDER BY total DESC, c_nationkey LIMIT 1) AS is_main FROM n""",
}
