"""Edge prices by lens, permit runs, locality order."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.operators import permits, pricing
from strider.sources.tables import table

LENSES = [("plain", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0), ("scenic", 0.5, 0.4, 0.3, 0.1, 0.1, 0.1, 0.45, 1.0, 0.5), ("flat", 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.2, 0.0, 4.0)]
_DDL = "lens string, w_cover double, w_landmark double, w_art double, w_commercial double, w_historic double, w_bridge double, w_highway double, w_industrial double, w_hill double"


def _edges(spark, d):
    p = table(spark, d, "part")
    byte = lambda m, c=0: ((F.col("p_partkey") * m + c) % 255).cast("int")
    return p.select(F.col("p_partkey").alias("edge"), F.col("p_retailprice").alias("length_m"), byte(7).alias("cover"), byte(11).alias("landmark"), byte(13).alias("art"), byte(17).alias("commercial"), byte(19).alias("historic"), byte(23).alias("bridge"), byte(29).alias("highway"), byte(31).alias("industrial"), byte(37).alias("ascent"), (byte(41) / 3).cast("int").alias("descent"))


def edge_prices(spark, d):
    out = pricing.priced(_edges(spark, d), spark.createDataFrame(LENSES, _DDL))
    return out.select("edge", "lens", F.round("raw_s", 5).alias("raw_s"), F.round("effective_s", 5).alias("effective_s"))


def price_bounds(spark, d):
    lenses = spark.createDataFrame(LENSES, _DDL)
    return pricing.factor_maxima(_edges(spark, d)).join(lenses, F.lit(True), "cross").select("lens", F.round(pricing.lowest_multiplier(), 9).alias("bound"))


def route_factor_shares(spark, d):
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("route"), F.col("l_quantity").alias("seconds"), (F.col("l_partkey") % 255).cast("int").alias("cover"), (F.col("l_suppkey") * 3 % 255).cast("int").alias("highway"))
    out = pricing.route_shares(steps, ["cover", "highway"])
    return out.select("route", "seconds", F.round("cover", 8).alias("cover"), F.round("highway", 8).alias("highway"))


def waits(spark, d):
    w = F.when(F.col("p_partkey") % 10 != 0, (F.col("p_size") * 60).cast("double"))
    return table(spark, d, "part").select("p_partkey", pricing.capped_wait(w, pricing.RAIL_WAIT_S, pricing.BOARDING_S).alias("board_s"), F.round(pricing.familiarity(F.col("p_size") / 10), 8).alias("familiar"))


def _snapshots(spark, d):
    """Customers with an order in a week as permits that the week's snapshot lists."""
    o = table(spark, d, "orders")
    return o.select(F.date_trunc("week", F.col("o_orderdate").cast("timestamp")).cast("date").alias("day"), (F.col("o_custkey") % 120).alias("job")).distinct()


def permit_days(spark, d):
    return permits.judged_days(_snapshots(spark, d))


def permit_runs(spark, d):
    return permits.permit_runs(_snapshots(spark, d))


QUERIES = {"edge_prices": edge_prices, "price_bounds": price_bounds, "route_factor_shares": route_factor_shares, "ride_waits": waits, "permit_days": permit_days, "permit_runs": permit_runs}

_EDGE = """e AS (SELECT p_partkey AS edge, p_retailprice AS m, p_partkey * 7 % 255 AS cover, p_partkey * 11 % 255 AS landmark, p_partkey * 13 % 255 AS art, p_partkey * 17 % 255 AS commercial, p_partkey * 19 % 255 AS historic,
    p_partkey * 23 % 255 AS bridge, p_partkey * 29 % 255 AS highway, p_partkey * 31 % 255 AS industrial, p_partkey * 37 % 255 AS ascent, (p_partkey * 41 % 255) // 3 AS descent FROM part),
w AS (SELECT * FROM (VALUES ('plain', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('scenic', 0.5, 0.4, 0.3, 0.1, 0.1, 0.1, 0.45, 1.0, 0.5), ('flat', 0.1, 0.0, 0.0, 0.0, 0.0, 0.0, 0.2, 0.0, 4.0))
    t(lens, w1, w2, w3, w4, w5, w6, w7, w8, w9))"""
_SNAP = "s AS (SELECT DISTINCT CAST(date_trunc('week', o_orderdate) AS DATE) AS day, o_custkey % 120 AS job FROM orders)"
_DAYS = _SNAP + """, c AS (SELECT day, count(*) AS n FROM s GROUP BY day),
l AS (SELECT *, list_sort(list(n) OVER (ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)) AS b FROM c), j AS (SELECT day, n, coalesce(n >= 0.75 * b[len(b) // 2 + 1], true) AS kept FROM l)"""
ORACLES = {
    "edge_prices": f"""WITH {_EDGE}, g AS (SELECT *, ascent / 255.0::DOUBLE * 0.35 AS u, descent / 255.0::DOUBLE * 0.35 AS v FROM e),
r AS (SELECT *, m / (1.3 * CASE WHEN u + v = 0 THEN 1 ELSE (u + v) / (u / exp(-3.5 * (abs(u + v + 0.05) - 0.05)) + v / exp(-3.5 * (abs(-(u + v) + 0.05) - 0.05))) END) AS raw FROM g)
SELECT edge, lens, round(raw, 5) AS raw_s, round(raw * (1 - w1 * cover / 255) * (1 - w2 * landmark / 255) * (1 - w3 * art / 255) * (1 - w4 * commercial / 255) * (1 - w5 * historic / 255) * (1 - w6 * bridge / 255)
    * (1 + w7 * highway / 255) * (1 + w8 * industrial / 255) * (1 + w9 * pow((u + v) / 0.12, 2)), 5) AS effective_s FROM r, w""",
    "price_bounds": f"""WITH {_EDGE} SELECT lens, round(any_value((1 - w1 * a / 255) * (1 - w2 * b / 255) * (1 - w3 * c / 255) * (1 - w4 * d / 255) * (1 - w5 * h / 255) * (1 - w6 * i / 255)), 9) AS bound
FROM w, (SELECT max(cover) AS a, max(landmark) AS b, max(art) AS c, max(commercial) AS d, max(historic) AS h, max(bridge) AS i FROM e) GROUP BY lens""",
    "route_factor_shares": """SELECT l_orderkey AS route, sum(l_quantity) AS seconds, round(sum(l_quantity * (l_partkey % 255)) / sum(l_quantity) / 255, 8) AS cover, round(sum(l_quantity * (l_suppkey * 3 % 255)) / sum(l_quantity) / 255, 8) AS highway
FROM lineitem GROUP BY l_orderkey""",
    "ride_waits": """SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 OR p_size * 60 > 1800 THEN 'infinity'::DOUBLE ELSE p_size * 60 + 60.0::DOUBLE END AS board_s, round(1 - exp(-p_size / 10.0::DOUBLE / 2), 8) AS familiar FROM part""",
    "permit_days": f"WITH {_DAYS} SELECT day, n, kept FROM j",
    "permit_runs": f"""WITH {_DAYS}, k AS (SELECT day, row_number() OVER (ORDER BY day) AS i FROM j WHERE kept),
r AS (SELECT job, day, i, i - row_number() OVER (PARTITION BY job ORDER BY i) AS g FROM s JOIN k USING (day))
SELECT job, min(day) AS first, CASE WHEN max(i) < (SELECT max(i) FROM k) THEN max(day) END AS last FROM r GROUP BY job, g""",
}
