"""Rule joins, timetables, search, rasters and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.functions import text
from strider.operators import joins, raster, search, transit
from strider.sources.tables import table


def priced_orders(spark, d):
    o, c, n = table(spark, d, "orders"), table(spark, d, "customer"), table(spark, d, "nation")
    rows = o.join(c, o["o_custkey"] == c["c_custkey"]).join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"])
    return rows.groupBy("n_name", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("price"))


def idle_customers(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


def busy_customers(spark, d):
    o = table(spark, d, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


def fallback_match(spark, d):
    """A supplier in the customer's nation and band, else in the nation, else none."""
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey", F.floor(F.col("c_acctbal") / 1000).alias("band"))
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.floor(F.col("s_acctbal") / 1000).alias("sband"))
    keys = [(F.struct("c_nationkey", "band"), F.struct("s_nationkey", "sband")), (F.col("c_nationkey"), F.col("s_nationkey"))]
    keys = [(F.to_json(a) if i == 0 else a, F.to_json(b.cast("struct<c_nationkey:int,band:bigint>")) if i == 0 else b) for i, (a, b) in enumerate(keys)]
    return joins.first_match(c, s, keys, "s_suppkey", ["s_suppkey"], "supplier").select("c_custkey", "supplier")


def next_purchase(spark, d):
    e = table(spark, d, "events")
    errors = e.where("event_type = 'click'").select("user_id", "event_id", "ts")
    buys = e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("then"))
    out = joins.asof_forward(errors, buys, "user_id", "ts", "then", "next")
    return out.select("event_id", F.unix_timestamp(F.col("next").cast("timestamp")).alias("next_s"))


def next_departures(spark, d):
    p = table(spark, d, "part").select("p_partkey", (F.col("p_partkey") % 7 * 3600).cast("int").alias("start"), (F.col("p_partkey") % 7 * 3600 + F.col("p_size") * 200).cast("int").alias("end"), (F.col("p_partkey") % 5 * 300).cast("int").alias("headway"), F.lit(14_000).alias("at"))
    return p.select("p_partkey", joins.next_in_band(F.col("start"), F.col("end"), F.col("headway"), F.col("at")).cast("long").alias("next"))


def running_services(spark, d):
    """Suppliers as services from their first to their last shipment, orders as exceptions, all order days."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("service"), (F.col("s_suppkey") * 37 % 128).cast("int").alias("mask"))
    ships = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("service")).agg(F.to_date(F.min("l_shipdate")).alias("first"), F.to_date(F.max("l_shipdate")).alias("last"))
    x = table(spark, d, "orders").select((F.col("o_custkey") % 100 + 1).alias("service"), F.to_date("o_orderdate").alias("day"), (F.col("o_orderkey") % 2 + 1).cast("int").alias("kind")).groupBy("service", "day").agg(F.min("kind").alias("kind"))
    return joins.active_services(s.join(ships, "service"), x, x.select("day").distinct())


def segment_times(spark, d):
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip"), F.col("l_returnflag").alias("route"), "l_linenumber", "l_partkey", (F.col("l_suppkey") % 12).alias("stop"), ((F.col("l_orderkey") % 900) * 60 + F.col("l_linenumber") * 300 + F.col("l_partkey") % 120).cast("double").alias("dep"))  # noqa: E741
    rows = l.groupBy("trip", F.col("l_linenumber").alias("seq")).agg(F.min(F.struct("l_partkey", "route", "stop", "dep")).alias("m")).select("trip", "seq", "m.route", "m.stop", "m.dep")
    return transit.segments(rows)


def shared_words(spark, d):
    """Parts by name: the first part with the same words, and how many others share half of them."""
    p = table(spark, d, "part").select("p_partkey", F.array_sort(F.array_distinct(text.tokens(F.lower("p_name")))).alias("t"))
    return joins.shared_half(p, "p_partkey", "t")


def name_search(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("doc"), text.tokens(F.lower("p_name")).alias("tokens"), F.pmod(F.col("p_size") * 5, F.lit(256)).alias("prominence"))
    names = table(spark, d, "part").where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("q"), text.tokens(F.lower("p_name")).alias("t"))
    queries = names.select("q", F.concat(F.slice("t", 1, F.greatest(F.lit(0), F.size("t") - 1)), F.array(F.substring(F.element_at("t", -1), 1, 3))).alias("tokens"))
    return search.search_names(docs, queries, 10).select("q", "doc", F.round("score", 6).alias("score"))


def cells(spark, d):
    p = table(spark, d, "part").select((F.col("p_partkey") % 45).alias("x"), F.floor(F.col("p_partkey") / 45).alias("y"), F.when(F.col("p_partkey") % 13 != 0, F.col("p_size").cast("double")).alias("value"))
    return p


def raster_pyramid(spark, d):
    return raster.pyramid(cells(spark, d), 3).select("z", "x", "y", F.round("value", 6).alias("value"), "cells")


def relief(spark, d):
    return raster.hillshade(cells(spark, d), 10.0).select("x", "y", F.round("shade", 6).alias("shade"))


def filled(spark, d):
    return raster.close_holes(cells(spark, d)).select("x", "y", F.round("value", 6).alias("value"))


def zones(spark, d):
    z = table(spark, d, "supplier").select(F.col("s_suppkey").alias("zone"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("i")).select("zone", ((F.col("zone") + F.col("i")) % 45).alias("x"), (F.col("zone") % 40).alias("y"))
    out = raster.zonal(cells(spark, d), z)
    return out.select("zone", "cells", F.round("mean", 6).alias("mean"), "top")


def merged_sources(spark, d):
    """Customers and suppliers as one set; of the same nation and name tail the customer stands."""
    c = table(spark, d, "customer").select(F.lit(0).alias("rank"), F.col("c_nationkey").alias("nation"), (F.col("c_custkey") % 1000).alias("tail"), F.col("c_custkey").alias("id"))
    s = table(spark, d, "supplier").select(F.lit(1).alias("rank"), F.col("s_nationkey").alias("nation"), (F.col("s_suppkey") % 1000).alias("tail"), F.col("s_suppkey").alias("id"))
    return c.unionByName(s).groupBy("nation", "tail").agg(F.min(F.struct("rank", "id")).alias("m")).select("nation", "tail", "m.rank", "m.id")


def set_algebra(spark, d):
    a = table(spark, d, "lineitem").where("l_returnflag = 'R'").select("l_partkey")
    b = table(spark, d, "lineitem").where("l_linestatus = 'O'").select("l_partkey")
    return a.exceptAll(b).distinct().withColumn("kind", F.lit("only_r")).unionByName(a.intersect(b).withColumn("kind", F.lit("both")))


def newest(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "user_id")


def dictionary(spark, d):
    from pyspark.sql import Window

    n = table(spark, d, "part").select("p_type", "p_brand").distinct()
    return n.select("p_type", "p_brand", F.row_number().over(Window.partitionBy("p_type").orderBy("p_brand")).alias("code"))


QUERIES = {
    "priced_orders": priced_orders, "idle_customers": idle_customers, "busy_customers": busy_customers, "fallback_match": fallback_match, "next_purchase": next_purchase, "next_departures": next_departures,
    "running_services": running_services, "segment_times": segment_times, "shared_words": shared_words, "name_search": name_search, "raster_pyramid": raster_pyramid, "hillshade": relief, "closed_holes": filled,
    "zonal_stats": zones, "merged_sources": merged_sources, "set_algebra": set_algebra, "newest_events": newest, "dictionary_codes": dictionary,
}

_CELLS = "c AS (SELECT p_partkey % 45 AS x, p_partkey // 45 AS y, CASE WHEN p_partkey % 13 <> 0 THEN CAST(p_size AS DOUBLE) END AS value FROM part)"
_TOK = "list_filter(string_split_regex(lower(p_name), '[^a-z0-9]+'), lambda x: x <> '')"
ORACLES = {
    "priced_orders": "SELECT n_name, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL",
    "idle_customers": "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    "busy_customers": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "fallback_match": """SELECT c_custkey, coalesce((SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey AND floor(s_acctbal / 1000) = floor(c_acctbal / 1000)),
    (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = c_nationkey)) AS supplier FROM customer""",
    "next_purchase": """SELECT e.event_id, CAST(floor(epoch((SELECT min(p.ts) FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase' AND p.ts >= e.ts))) AS BIGINT) AS next_s FROM events e WHERE e.event_type = 'click'""",
    "next_departures": """WITH b AS (SELECT p_partkey, p_partkey % 7 * 3600 AS s, p_partkey % 7 * 3600 + p_size * 200 AS e, p_partkey % 5 * 300 AS h FROM part)
SELECT p_partkey, CAST(CASE WHEN 14000 <= s THEN s WHEN 14000 > e OR h <= 0 THEN NULL ELSE least(e, s + ceil((14000 - s) / h) * h) END AS BIGINT) AS next FROM b""",
    "running_services": """WITH s AS (SELECT s_suppkey AS service, s_suppkey * 37 % 128 AS mask, CAST(min(l_shipdate) AS DATE) AS f, CAST(max(l_shipdate) AS DATE) AS l FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey),
x AS (SELECT o_custkey % 100 + 1 AS service, CAST(o_orderdate AS DATE) AS day, min(o_orderkey % 2 + 1) AS kind FROM orders GROUP BY ALL),
d AS (SELECT DISTINCT day FROM x)
SELECT day, service FROM d, s WHERE day BETWEEN f AND l AND (mask >> CAST(isodow(day) - 1 AS INTEGER)) & 1 = 1 AND NOT EXISTS (SELECT 1 FROM x WHERE x.service = s.service AND x.day = d.day AND kind = 2)
UNION SELECT day, service FROM x WHERE kind = 1 AND day IN (SELECT day FROM d)""",
    "segment_times": """WITH l AS (SELECT l_orderkey AS trip, l_linenumber AS seq, arg_min(l_returnflag, (l_partkey, l_returnflag, l_suppkey % 12)) AS route, arg_min(l_suppkey % 12, (l_partkey, l_returnflag, l_suppkey % 12)) AS stop,
    CAST((l_orderkey % 900) * 60 + l_linenumber * 300 + min(l_partkey) % 120 AS DOUBLE) AS dep FROM lineitem GROUP BY l_orderkey, l_linenumber),
h AS (SELECT * FROM (SELECT route, stop AS a, lead(stop) OVER w AS b, dep, lead(dep) OVER w - dep AS s FROM l WINDOW w AS (PARTITION BY trip ORDER BY seq)) WHERE b IS NOT NULL AND b <> a),
g AS (SELECT a, b, dep - lag(dep) OVER (PARTITION BY a, b ORDER BY dep) AS gap FROM (SELECT DISTINCT a, b, dep FROM h)),
w AS (SELECT a, b, median(gap) AS gap FROM g GROUP BY ALL), r AS (SELECT a, b, arg_min(route, (-n, route)) AS route FROM (SELECT a, b, route, count(*) AS n FROM h GROUP BY ALL) GROUP BY a, b),
t AS (SELECT a, b, median(s) AS crossing_s FROM h GROUP BY a, b)
SELECT a, b, crossing_s, CASE WHEN gap / 2 < 600 THEN gap / 2 ELSE 600.0 END AS wait_s, route FROM t JOIN w USING (a, b) JOIN r USING (a, b)""",
    "shared_words": f"""WITH p AS (SELECT p_partkey, list_sort(list_distinct({_TOK})) AS t FROM part)
SELECT a.p_partkey, min(b.p_partkey) FILTER (WHERE a.t = b.t) AS same, count(*) - 1 AS links FROM p a, p b
WHERE len(list_intersect(a.t, b.t)) > 0 AND 2 * len(list_intersect(a.t, b.t)) >= len(a.t) + len(b.t) - len(list_intersect(a.t, b.t)) GROUP BY a.p_partkey""",
    "name_search": f"""WITH d AS (SELECT p_partkey AS doc, {_TOK} AS t, (p_size * 5) % 256 AS prom FROM part),
i AS (SELECT doc, len(t) AS words, unnest(t) AS token, unnest(range(0, len(t))) AS pos FROM d),
q AS (SELECT doc AS q, t[1:len(t) - 1] || [substr(t[len(t)], 1, 3)] AS t FROM d WHERE doc % 20 = 0),
w AS (SELECT q, len(t) AS n, unnest(t) AS word, unnest(range(0, len(t))) AS k FROM q),
m AS (SELECT q, n, k, doc, words, max(CASE WHEN token = word THEN 1.0::DOUBLE ELSE 0.8::DOUBLE + 0.2::DOUBLE * length(word) / length(token) END) AS quality, min(pos) AS pos
    FROM w JOIN i ON token = word OR (k = n - 1 AND starts_with(token, word)) GROUP BY ALL),
h AS (SELECT q, n, doc, words, count(*) AS found, sum(quality) AS s, bool_or(k = 0 AND pos = 0) AS leads FROM m GROUP BY ALL),
x AS (SELECT q, h.doc, words, prom, s / n * pow(least(1.0::DOUBLE, found / words), 0.3) * CASE WHEN leads THEN 1.1::DOUBLE ELSE 1 END * CASE WHEN found = words AND found = n THEN 1.15::DOUBLE ELSE 1 END
    * CASE WHEN found < n THEN 0.4::DOUBLE ELSE 1 END * (0.3::DOUBLE + 0.7::DOUBLE * prom / 255) AS score FROM h JOIN d ON d.doc = h.doc),
r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, prom DESC, words, doc) AS rank FROM x) SELECT q, doc, round(score, 6) AS score FROM r WHERE rank <= 10""",
    "raster_pyramid": f"WITH {_CELLS} SELECT CAST(z AS INTEGER) AS z, x >> CAST(z AS INTEGER) AS x, y >> CAST(z AS INTEGER) AS y, round(avg(value), 6) AS value, count(*) AS cells FROM c, range(4) t(z) GROUP BY ALL",
    "hillshade": f"""WITH {_CELLS}, g AS (SELECT c.x, c.y, (e.value - w.value) / 20 AS gx, (s.value - n.value) / 20 AS gy FROM c LEFT JOIN c w ON w.x = c.x - 1 AND w.y = c.y LEFT JOIN c e ON e.x = c.x + 1 AND e.y = c.y
    LEFT JOIN c n ON n.x = c.x AND n.y = c.y - 1 LEFT JOIN c s ON s.x = c.x AND s.y = c.y + 1)
SELECT x, y, round(CASE WHEN gx IS NULL OR gy IS NULL THEN 1 ELSE 0.65 + 0.5 * greatest(0, least(1, (gx * 0.5 - gy * 0.5 + 0.7071) / sqrt(gx * gx + gy * gy + 1))) END, 6) AS shade FROM g""",
    "closed_holes": f"""WITH {_CELLS} SELECT a.x, a.y, round(coalesce(any_value(a.value), CASE WHEN count(b.value) >= 3 THEN avg(b.value) END), 6) AS value
FROM c a LEFT JOIN c b ON abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y) GROUP BY a.x, a.y""",
    "zonal_stats": f"""WITH {_CELLS}, z AS (SELECT s_suppkey AS zone, (s_suppkey + i) % 45 AS x, s_suppkey % 40 AS y FROM supplier, range(7) t(i))
SELECT zone, count(value) AS cells, round(avg(value), 6) AS mean, quantile_disc(value, 0.9) AS top FROM z JOIN c USING (x, y) GROUP BY zone""",
    "merged_sources": """WITH u AS (SELECT 0 AS rank, c_nationkey AS nation, c_custkey % 1000 AS tail, c_custkey AS id FROM customer UNION ALL SELECT 1, s_nationkey, s_suppkey % 1000, s_suppkey FROM supplier)
SELECT nation, tail, min(rank) AS rank, arg_min(id, (rank, id)) AS id FROM u GROUP BY nation, tail""",
    "set_algebra": """WITH a AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
SELECT a.l_partkey, 'only_r' AS kind FROM a LEFT JOIN b USING (l_partkey) WHERE a.n > coalesce(b.n, 0) UNION ALL SELECT l_partkey, 'both' FROM a JOIN b USING (l_partkey)""",
    "newest_events": "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "dictionary_codes": "SELECT p_type, p_brand, CAST(row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS INTEGER) AS code FROM (SELECT DISTINCT p_type, p_brand FROM part)",
}
