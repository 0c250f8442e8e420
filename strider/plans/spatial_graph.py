"""Spatial joins and graph queries over stand-in geometry of the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.operators import graph, spatial
from strider.sources.tables import table


def _points(spark, d, name="lid"):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias(name), (F.col("embedding")[0].cast("double") * 1000).alias("x"), (F.col("embedding")[1].cast("double") * 1000).alias("y"))
    return e


def _grid(spark, d):
    p = table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("rid"), ((F.col("p_partkey") * 37) % 801 - 400).cast("double").alias("x"), ((F.col("p_partkey") * 91) % 797 - 398).cast("double").alias("y"), (F.col("p_size") / 50.0).alias("w"))


def _boxes(spark, d):
    c = table(spark, d, "supplier").select(F.col("s_suppkey").alias("poly"), ((F.col("s_suppkey") * 53) % 600 - 300).cast("double").alias("cx"), ((F.col("s_suppkey") * 29) % 600 - 300).cast("double").alias("cy"))
    corner = lambda dx, dy: F.struct((F.col("cx") + dx).alias("x"), (F.col("cy") + dy).alias("y"))
    return c.select("poly", F.array(corner(-40, -25), corner(35, -30), corner(45, 20), corner(0, 50), corner(-38, 22)).alias("ring"))


def _streets(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("seg"), ((F.col("s_suppkey") * 53) % 600 - 300).cast("double").alias("ax"), ((F.col("s_suppkey") * 29) % 600 - 300).cast("double").alias("ay"))
    return s.select("seg", "ax", "ay", (F.col("ax") + 60 + F.col("seg") % 7 * 10).alias("bx"), (F.col("ay") + F.col("seg") % 11 * 12 - 50).alias("by"))


def near_pairs(spark, d):
    out = spatial.within(_points(spark, d), _points(spark, d, "rid"), 40.0).where("lid < rid")
    return out.select("lid", "rid", F.round("dist", 4).alias("dist"))


def nearest_points(spark, d):
    return spatial.nearest(_points(spark, d), _grid(spark, d), 60.0).select("lid", "rid", F.round("dist", 4).alias("dist"))


def point_frontage(spark, d):
    return spatial.frontage(_grid(spark, d).withColumnRenamed("rid", "id"), _streets(spark, d), 35.0).select("id", "seg", F.round("dist", 4).alias("dist"))


def points_in_boxes(spark, d):
    return spatial.point_in_polygon(_grid(spark, d).withColumnRenamed("rid", "id"), _boxes(spark, d), 50.0)


def inside_shares(spark, d):
    return spatial.contained_fraction(_streets(spark, d).withColumnRenamed("seg", "line"), _boxes(spark, d), 5.0, 50.0).select("line", F.round("inside", 6).alias("inside"))


def amenities(spark, d):
    v = spatial.influences(_points(spark, d), _grid(spark, d), 20.0).groupBy("lid").agg(F.max("v").alias("highest"), F.sum("v").alias("total"))
    return v.select("lid", F.round("highest", 6).alias("highest"), F.round(1 - F.exp(-F.col("total")), 6).alias("amenity"))


def crowded(spark, d):
    return spatial.farther_copies(_grid(spark, d).withColumnRenamed("rid", "lid"), 15.0)


def _edges(spark, d):
    """Supplier and part nodes; the shortest of parallel edges."""
    l = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b"), F.col("l_quantity").alias("w"))  # noqa: E741
    return l.groupBy("a", "b").agg(F.min("w").alias("w"))


def graph_components(spark, d):
    e = _edges(spark, d).where("w > 40")
    return graph.components(e)


def reach_from(spark, d):
    seeds = spark.createDataFrame([(1, 0.0)], "node bigint, dist double")
    return graph.shortest_within(graph.both_ways(_edges(spark, d)), seeds, 24.0).select("node", "dist")


def hop_counts(spark, d):
    seeds = spark.createDataFrame([(1, 0.0), (2, 0.0)], "node bigint, dist double")
    one = graph.both_ways(_edges(spark, d).withColumn("w", F.lit(1.0)))
    return graph.shortest_within(one, seeds, 4.0).select("node", "dist")


def node_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


def parallel_edges(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("edge"), "l_linenumber", (F.col("l_suppkey") % 40).alias("a"), (F.col("l_partkey") % 40).alias("b"), F.col("l_quantity").alias("w"))
    return graph.collapse_parallel(e, ["w", "edge", "l_linenumber", "a", "b"]).select("edge", "l_linenumber", F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v"), "w")


def crossing_nodes(spark, d):
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 10_000_000).alias("b"), F.col("l_returnflag").alias("kind"))
    return graph.nodes_with_only(e, "R")


def timed_reach(spark, d):
    """Walks between suppliers and parts, and rides at given times: earliest arrivals."""
    walk = graph.both_ways(_edges(spark, d).where("w <= 12")).select("a", "b", (F.col("w") * 10).alias("w"))
    rides = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 1_000_000).alias("b"), (F.col("l_orderkey") % 900).cast("double").alias("dep"))
    rides = rides.withColumn("arr", F.col("dep") + 25)
    seeds = spark.createDataFrame([(1, 100.0)], "node bigint, at double")
    return graph.timed_labels(walk, rides, seeds, 420.0)


QUERIES = {
    "near_pairs": near_pairs, "nearest_points": nearest_points, "point_frontage": point_frontage, "points_in_polygons": points_in_boxes, "inside_shares": inside_shares, "amenities": amenities, "crowded_points": crowded,
    "graph_components": graph_components, "reach_within": reach_from, "hop_counts": hop_counts, "node_degrees": node_degrees, "parallel_edges": parallel_edges, "crossing_nodes": crossing_nodes, "timed_reach": timed_reach,
}

_E = "e AS (SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y FROM embeddings)"
_G = "g AS (SELECT p_partkey AS id, CAST((p_partkey * 37) % 801 - 400 AS DOUBLE) AS x, CAST((p_partkey * 91) % 797 - 398 AS DOUBLE) AS y, p_size / 50.0 AS w FROM part)"
_S = """s AS (SELECT *, ax + 60 + seg % 7 * 10 AS bx, ay + seg % 11 * 12 - 50 AS "by" FROM (SELECT s_suppkey AS seg, CAST((s_suppkey * 53) % 600 - 300 AS DOUBLE) AS ax, CAST((s_suppkey * 29) % 600 - 300 AS DOUBLE) AS ay FROM supplier))"""
_P = """c AS (SELECT s_suppkey AS poly, CAST((s_suppkey * 53) % 600 - 300 AS DOUBLE) AS cx, CAST((s_suppkey * 29) % 600 - 300 AS DOUBLE) AS cy FROM supplier),
k AS (SELECT * FROM (VALUES (-40, -25, 35, -30), (35, -30, 45, 20), (45, 20, 0, 50), (0, 50, -38, 22), (-38, 22, -40, -25)) t(p, q, r, s)),
pe AS (SELECT poly, cx + p AS x1, cy + q AS y1, cx + r AS x2, cy + s AS y2 FROM c, k)"""
_EDGES = "ed AS (SELECT l_suppkey AS a, l_partkey + 1000000 AS b, min(l_quantity) AS w FROM lineitem GROUP BY ALL), bw AS (SELECT a, b, w FROM ed UNION ALL SELECT b, a, w FROM ed)"
ORACLES = {
    "near_pairs": f"WITH {_E} SELECT a.id AS lid, b.id AS rid, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS dist FROM e a, e b WHERE a.id < b.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 40",
    "nearest_points": f"""WITH {_E}, {_G}, d AS (SELECT e.id AS lid, g.id AS rid, sqrt((e.x - g.x) * (e.x - g.x) + (e.y - g.y) * (e.y - g.y)) AS dist FROM e, g)
SELECT lid, arg_min(rid, (dist, rid)) AS rid, round(min(dist), 4) AS dist FROM d WHERE dist <= 60 GROUP BY lid""",
    "point_frontage": f"""WITH {_G}, {_S}, t AS (SELECT id, seg, x, y, ax, ay, bx, "by", ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) AS t FROM g, s),
d AS (SELECT id, seg, sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * ("by" - ay)), 2)) AS dist FROM t WHERE t BETWEEN 0 AND 1)
SELECT id, arg_min(seg, (dist, seg)) AS seg, round(min(dist), 4) AS dist FROM d WHERE dist <= 35 GROUP BY id""",
    "points_in_polygons": f"""WITH {_G}, {_P} SELECT id, poly FROM g, pe WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY id, poly HAVING count(*) % 2 = 1""",
    "inside_shares": f"""WITH {_S}, {_P}, n AS (SELECT *, CAST(greatest(1, ceil(sqrt((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)) / 5.0)) AS INTEGER) AS n FROM s),
m AS (SELECT seg AS line, i, ax + (i + 0.5::DOUBLE) / n * (bx - ax) AS x, ay + (i + 0.5::DOUBLE) / n * ("by" - ay) AS y FROM (SELECT *, unnest(range(0, n)) AS i FROM n)),
h AS (SELECT DISTINCT line, i FROM (SELECT line, i, poly FROM m, pe WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY line, i, poly HAVING count(*) % 2 = 1))
SELECT m.line, round(count(h.i) / count(*), 6) AS inside FROM m LEFT JOIN h ON m.line = h.line AND m.i = h.i GROUP BY m.line""",
    "amenities": f"""WITH {_E}, {_G}, v AS (SELECT e.id AS lid, w * exp(-(pow(e.x - g.x, 2) + pow(e.y - g.y, 2)) / 800) AS v FROM e, g WHERE sqrt((e.x - g.x) * (e.x - g.x) + (e.y - g.y) * (e.y - g.y)) <= 60)
SELECT lid, round(max(v), 6) AS highest, round(1 - exp(-sum(v)), 6) AS amenity FROM v GROUP BY lid""",
    "crowded_points": f"WITH {_G} SELECT DISTINCT a.id AS lid FROM g a, g b WHERE b.id < a.id AND sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 15",
    "graph_components": f"""WITH RECURSIVE {_EDGES}, h AS (SELECT a, b FROM bw WHERE w > 40), r AS (SELECT a AS node, a AS top FROM h UNION SELECT h.b, r.top FROM r JOIN h ON h.a = r.node)
SELECT node, min(top) AS component FROM r GROUP BY node""",
    "reach_within": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(0 AS DOUBLE) AS dist UNION SELECT bw.b, r.dist + bw.w FROM r JOIN bw ON bw.a = r.node WHERE r.dist + bw.w <= 24)
SELECT node, min(dist) AS dist FROM r GROUP BY node""",
    "hop_counts": f"""WITH RECURSIVE {_EDGES}, r AS (SELECT node, 0 AS hop FROM (VALUES (CAST(1 AS BIGINT)), (2)) v(node) UNION SELECT bw.b, hop + 1 FROM r JOIN bw ON bw.a = r.node WHERE hop < 4)
SELECT node, CAST(min(hop) AS DOUBLE) AS dist FROM r GROUP BY node""",
    "node_degrees": f"WITH {_EDGES} SELECT a AS node, count(*) AS degree, sum(w) AS length FROM bw GROUP BY a",
    "parallel_edges": """WITH e AS (SELECT l_orderkey AS edge, l_linenumber, l_suppkey % 40 AS a, l_partkey % 40 AS b, l_quantity AS w FROM lineitem WHERE l_suppkey % 40 <> l_partkey % 40),
r AS (SELECT *, row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY w, edge, l_linenumber, a, b) AS i FROM e) SELECT edge, l_linenumber, least(a, b) AS u, greatest(a, b) AS v, w FROM r WHERE i = 1""",
    "crossing_nodes": """WITH x AS (SELECT l_orderkey AS node, l_returnflag AS k FROM lineitem UNION ALL SELECT l_partkey + 10000000, l_returnflag FROM lineitem) SELECT node FROM x GROUP BY node HAVING bool_and(k = 'R')""",
    "timed_reach": f"""WITH RECURSIVE {_EDGES}, w AS (SELECT a, b, w * 10 AS w FROM bw WHERE w <= 12), f AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b, CAST(l_orderkey % 900 AS DOUBLE) AS dep FROM lineitem),
r AS (SELECT CAST(1 AS BIGINT) AS node, CAST(100 AS DOUBLE) AS t UNION
    SELECT x.b, x.t FROM (SELECT w.b, r.t + w.w AS t FROM r JOIN w ON w.a = r.node UNION ALL SELECT f.b, f.dep + 25 FROM r JOIN f ON f.a = r.node AND f.dep >= r.t) x WHERE x.t <= 420)
SELECT node, min(t) AS at FROM r GROUP BY node""",
}
