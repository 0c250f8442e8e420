"""Networks: snapping, paths, topology around nodes, prices by kind."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from strider.operators import graph, pricing, routes
from strider.plans.spatial_graph import _E, _EDGES, _S, _edges, _points, _streets
from strider.sources.tables import table


def snap_pairs(spark, d):
    """Trips between embedding points over streets in five components."""
    points = _points(spark, d, "id")
    found = routes.snap_candidates(points, _streets(spark, d).withColumn("component", F.col("seg") % 5), 60.0)
    n = points.agg(F.count(F.lit(1)).alias("n"))
    trips = points.crossJoin(F.broadcast(n)).select(F.col("id").alias("trip"), F.col("id").alias("start"), ((F.col("id") * 7 + 3) % F.col("n")).alias("dest"))
    return routes.snap_pairs(trips, found).select("trip", "start_seg", "dest_seg", F.round("total", 4).alias("total"))


def route_paths(spark, d):
    """The way to every node in reach, back along the smallest parents."""
    seeds = spark.createDataFrame([(1, 0.0)], "node bigint, dist double")
    reached = graph.shortest_within(graph.both_ways(_edges(spark, d)), seeds, 12.0)
    return routes.paths(reached, reached.select("node")).groupBy("goal").agg(F.max("back").cast("bigint").alias("hops"), F.max_by("node", "back").alias("seed"))


def _steps(spark, d):
    angle = (F.col("l_partkey") * 37 % 360).cast("int")
    # The machine's own sine, as SQL has it: Java's differs in the last bit at 183 and 297 degrees, which shows where directions cancel.
    at = lambda f: F.get(F.array(*[F.lit(f(math.radians(k))) for k in range(360)]), angle)
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_quantity", "l_returnflag")).alias("m"))  # noqa: E741
    rows = l.select(F.col("l_orderkey").alias("route"), F.col("l_linenumber").alias("seq"), "m.l_partkey", F.col("m.l_quantity").alias("length"), F.when(F.col("m.l_returnflag") != "N", "crossing").otherwise("walk").alias("kind"))
    return rows.select("route", "seq", "kind", "length", at(math.cos).alias("x"), at(math.sin).alias("y"))


def crossing_reversals(spark, d):
    return routes.crossing_reversals(_steps(spark, d), 20.0, -0.7)


def detours(spark, d):
    """Length of an order's walk over the straight line between its ends."""
    s = _steps(spark, d)
    rows = s.groupBy("route").agg(F.sum("length").alias("walked"), F.sum(F.col("length") * F.col("x")).alias("dx"), F.sum(F.col("length") * F.col("y")).alias("dy"))
    ratio = routes.detour_ratio(F.col("walked"), F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    # To four places as SQL rounds: scaled, so that the last bit agrees also for walks that all but return (ratios beyond 2^53).
    return rows.select("route", (F.round(ratio * 1e4) / 1e4).alias("ratio"))


def merged_nodes(spark, d):
    return routes.merged_nodes(_points(spark, d, "id"), 4.0, 12.0)


def turn_bearings(spark, d):
    v = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("x"), F.min("l_suppkey").alias("y"))
    out = routes.turn_bearings(v.select(F.col("l_orderkey").alias("line"), F.col("l_linenumber").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))
    return out.select("line", "seq", F.round("bearing", 8).alias("bearing"), routes.side_label(F.col("bearing")).alias("side"))


def corner_fans(spark, d):
    e = _edges(spark, d)
    ends = e.select(F.col("a").alias("node"), F.col("b").alias("edge"), (F.col("b") * 37 % 360).alias("bearing"))
    return routes.fans(ends)


def chains(spark, d):
    """Order lines as edges between consecutive parts; runs through parts of degree two are one."""
    l = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 10_000_000).alias("b"), "l_linenumber", F.col("l_returnflag").alias("key"))  # noqa: E741
    e = l.groupBy("a", "b").agg(F.min("key").alias("key")).withColumn("edge", F.col("a") * 100_000_000 + F.col("b")).withColumn("w", F.lit(1.0))
    return graph.chains(e).groupBy("chain").agg(F.count(F.lit(1)).alias("edges"), F.max("edge").alias("last"))


def islands(spark, d):
    """Edges of components with an anchor; the others are islands."""
    e = _edges(spark, d).where("w > 40")
    anchors = table(spark, d, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("node"))
    return graph.anchored(e, anchors).select("a", "b", "w")


def edge_terms(spark, d):
    p = table(spark, d, "part")
    tunnel, attribute, shed = F.col("p_partkey") % 11 == 0, (F.col("p_partkey") * 7 % 201 - 100) / 100.0, (F.col("p_partkey") * 13 % 101) / 100.0
    intensity, canopy, weight = (F.col("p_size") / 50.0), F.col("p_partkey") * 29 % 255, (F.col("p_partkey") * 3 % 120) / 100.0
    shade = pricing.shade_attribute(tunnel, attribute, intensity, shed)
    blended = (1 - weight * shade) * (1 - shed) + shed + pricing.SHED_PENALTY * shed
    return p.select("p_partkey", F.round(shade, 8).alias("shade"), F.round(pricing.shelter_attribute(tunnel, canopy, 0.6, shed), 8).alias("shelter"), F.round(pricing.ride_multiplier(weight, shed), 8).alias("ride"), F.round(pricing.crossing_discount(weight, shed), 8).alias("ferry"), F.round(blended, 8).alias("barred"))


def kind_seconds(spark, d):
    kinds = F.array(*[F.lit(x) for x in ("walk", "crossing", "ferry", "board", "ride", "access")])
    e = table(spark, d, "part").select("p_partkey", F.get(kinds, (F.col("p_partkey") % 6).cast("int")).alias("kind"), (F.col("p_size") * 30).alias("duration_s"), F.col("p_retailprice").alias("length_m"), F.lit(0).alias("ascent"), F.lit(0).alias("descent"), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") * 130.0).alias("wait"))
    return e.select("p_partkey", F.round(pricing.kind_seconds(F.col("wait"), F.col("p_partkey") % 4 == 0), 5).alias("seconds"))


QUERIES = {
    "snap_pairs": snap_pairs, "route_paths": route_paths, "crossing_reversals": crossing_reversals, "detour_ratios": detours, "merged_nodes": merged_nodes, "turn_bearings": turn_bearings,
    "corner_fans": corner_fans, "edge_chains": chains, "island_edges": islands, "edge_terms": edge_terms, "kind_seconds": kind_seconds,
}

_STEPS = """st AS (SELECT l_orderkey AS route, l_linenumber AS seq, arg_min(l_quantity, k) AS length, CASE WHEN arg_min(l_returnflag, k) <> 'N' THEN 'crossing' ELSE 'walk' END AS kind,
    cos(radians(CAST(min(l_partkey) * 37 % 360 AS DOUBLE))) AS x, sin(radians(CAST(min(l_partkey) * 37 % 360 AS DOUBLE))) AS y FROM (SELECT *, (l_partkey, l_quantity, l_returnflag) AS k FROM lineitem) GROUP BY l_orderkey, l_linenumber)"""
ORACLES = {
    "snap_pairs": f"""WITH {_E}, {_S}, t AS (SELECT id, seg, x, y, ax, ay, bx, "by", greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) AS t FROM e, s),
d AS (SELECT id, seg, seg % 5 AS component, sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * ("by" - ay)), 2)) AS dist FROM t),
c AS (SELECT id, component, arg_min(seg, (dist, seg)) AS seg, min(dist) AS dist FROM d WHERE dist <= 60 GROUP BY ALL)
SELECT a.id AS trip, arg_min(a.seg, (a.dist + b.dist, a.component)) AS start_seg, arg_min(b.seg, (a.dist + b.dist, a.component)) AS dest_seg, round(min(a.dist + b.dist), 4) AS total
FROM c a JOIN c b ON b.id = (a.id * 7 + 3) % (SELECT count(*) FROM embeddings) AND a.component = b.component GROUP BY a.id""",
    "route_paths": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS dist UNION SELECT bw.b, r.dist + bw.w FROM r JOIN bw ON bw.a = r.node WHERE r.dist + bw.w <= 12),
m AS (SELECT node, min(dist) AS dist FROM r GROUP BY node), p AS (SELECT m.node, min(bw.a) AS parent FROM m JOIN bw ON bw.b = m.node JOIN m f ON f.node = bw.a AND f.dist + bw.w = m.dist WHERE m.node <> 1 GROUP BY m.node),
w AS (SELECT node AS goal, node, 0 AS back FROM m UNION ALL SELECT goal, parent, back + 1 FROM w JOIN p ON p.node = w.node) SELECT goal, CAST(max(back) AS BIGINT) AS hops, arg_max(node, back) AS seed FROM w GROUP BY goal""",
    "crossing_reversals": f"""WITH {_STEPS}, a AS (SELECT *, sum(length) OVER (PARTITION BY route ORDER BY seq ROWS UNBOUNDED PRECEDING) AS ends FROM st),
c AS (SELECT route, seq, ends - length - lag(ends) OVER w AS between_m, x * lag(x) OVER w + y * lag(y) OVER w AS turn FROM a WHERE kind = 'crossing' WINDOW w AS (PARTITION BY route ORDER BY seq))
SELECT route, seq, between_m AS "between" FROM c WHERE between_m <= 20 AND turn <= -0.7""",
    "detour_ratios": f"""WITH {_STEPS}, g AS (SELECT route, sum(length) AS w, sqrt(pow(sum(length * x), 2) + pow(sum(length * y), 2)) AS s FROM st GROUP BY route) SELECT route, round(CASE WHEN s > 0 THEN w / s END, 4) AS ratio FROM g""",
    "merged_nodes": f"""WITH RECURSIVE {_E}, q AS (SELECT id, floor(x / 4 + 0.5) AS qx, floor(y / 4 + 0.5) AS qy FROM e), u AS (SELECT qx, qy, min(id) AS f FROM q GROUP BY ALL),
c AS (SELECT a.f AS a, b.f AS b FROM u a, u b WHERE a.f <> b.f AND sqrt(pow((a.qx - b.qx) * 4, 2) + pow((a.qy - b.qy) * 4, 2)) <= 12),
r AS (SELECT f AS node, f AS top FROM u UNION SELECT c.b, r.top FROM r JOIN c ON c.a = r.node), m AS (SELECT node, min(top) AS top FROM r GROUP BY node)
SELECT q.id, m.top AS node FROM q JOIN u USING (qx, qy) JOIN m ON m.node = u.f""",
    "turn_bearings": """WITH v AS (SELECT l_orderkey AS line, l_linenumber AS seq, CAST(min(l_partkey) AS DOUBLE) AS x, CAST(min(l_suppkey) AS DOUBLE) AS y FROM lineitem GROUP BY ALL),
b AS (SELECT line, seq, coalesce(lead(x) OVER w, x) - coalesce(lag(x) OVER w, x) AS dx, coalesce(lead(y) OVER w, y) - coalesce(lag(y) OVER w, y) AS dy FROM v WINDOW w AS (PARTITION BY line ORDER BY seq)),
t AS (SELECT line, seq, CASE WHEN dx <> 0 OR dy <> 0 THEN atan2(dx, dy) END AS t FROM b)
SELECT line, seq, round(t, 8) AS bearing, ['N', 'E', 'S', 'W'][CAST(least(3, floor((t - pi() / 4 + 2 * pi() - 2 * pi() * floor((t - pi() / 4 + 2 * pi()) / (2 * pi()))) / (pi() / 2))) AS INTEGER) + 1] AS side FROM t""",
    "corner_fans": f"""WITH {_EDGES} SELECT a AS node, b AS edge, coalesce(lead(b) OVER w, first_value(b) OVER w) AS next_edge FROM ed WINDOW w AS (PARTITION BY a ORDER BY b * 37 % 360, b)""",
    "edge_chains": """WITH RECURSIVE e AS (SELECT l_orderkey AS a, l_partkey + 10000000 AS b, min(l_returnflag) AS key, l_orderkey * 100000000 + l_partkey + 10000000 AS edge FROM lineitem GROUP BY ALL),
n AS (SELECT a AS node, edge, key FROM e UNION ALL SELECT b, edge, key FROM e), t AS (SELECT min(edge) AS a, max(edge) AS b FROM n GROUP BY node HAVING count(*) = 2 AND count(DISTINCT key) = 1 AND min(edge) <> max(edge)),
w AS (SELECT a, b FROM t UNION ALL SELECT b, a FROM t), r AS (SELECT a AS edge, a AS top FROM w UNION SELECT w.b, r.top FROM r JOIN w ON w.a = r.edge), m AS (SELECT edge, min(top) AS top FROM r GROUP BY edge)
SELECT coalesce(m.top, e.edge) AS chain, count(*) AS edges, max(e.edge) AS last FROM e LEFT JOIN m USING (edge) GROUP BY 1""",
    "island_edges": f"""WITH RECURSIVE {_EDGES}, h AS (SELECT a, b FROM bw WHERE w > 40), r AS (SELECT s_suppkey AS node FROM supplier WHERE s_acctbal < 0 UNION SELECT h.b FROM r JOIN h ON h.a = r.node)
SELECT a, b, w FROM ed WHERE w > 40 AND a IN (SELECT node FROM r)""",
    "edge_terms": """WITH p AS (SELECT p_partkey, p_partkey % 11 = 0 AS tunnel, (p_partkey * 7 % 201 - 100) / 100.0::DOUBLE AS attr, (p_partkey * 13 % 101) / 100.0::DOUBLE AS shed, p_size / 50.0::DOUBLE AS i, p_partkey * 29 % 255 AS canopy, (p_partkey * 3 % 120) / 100.0::DOUBLE AS w FROM part),
s AS (SELECT *, CASE WHEN tunnel THEN -i ELSE attr * (1 - shed) - shed * i END AS shade FROM p)
SELECT p_partkey, round(shade, 8) AS shade, round(CASE WHEN tunnel THEN 254 / 255.0::DOUBLE ELSE shed + 0.6::DOUBLE * canopy / 255 * (1 - shed) END, 8) AS shelter, round((1 + w) * greatest(0.05::DOUBLE, 1 - shed), 8) AS ride,
    round(greatest(0.05::DOUBLE, 1 - w) * greatest(0.05::DOUBLE, 1 - shed), 8) AS ferry, round((1 - w * shade) * (1 - shed) + shed + 20 * shed, 8) AS barred FROM s""",
    "kind_seconds": """WITH e AS (SELECT p_partkey, p_partkey % 6 AS k, p_size * 30 AS dur, p_retailprice AS m, CASE WHEN p_partkey % 5 <> 0 THEN p_size * 130.0::DOUBLE END AS wait, p_partkey % 4 = 0 AS mid FROM part)
SELECT p_partkey, round(CASE WHEN k = 2 THEN CASE WHEN wait IS NULL OR wait > 5400 THEN 'infinity'::DOUBLE ELSE wait + dur END WHEN k = 3 THEN CASE WHEN wait IS NULL OR wait > 1800 THEN 'infinity'::DOUBLE ELSE wait + 60 END
    WHEN k >= 4 THEN dur ELSE m / 1.3::DOUBLE + CASE WHEN k = 1 AND NOT mid THEN 3 ELSE 0 END END, 5) AS seconds FROM e""",
}
