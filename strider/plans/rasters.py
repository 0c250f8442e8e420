"""Tiles, strokes, fills and blurs; totals over networks and legs of a trip."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.functions import geo
from strider.operators import graph, raster, spatial, stats, windows
from strider.plans.joins_search import _CELLS, cells
from strider.plans.spatial_graph import _E, _EDGES, _G, _P, _S, _boxes, _edges, _grid, _points, _streets
from strider.sources.tables import table


def tile_plan(spark, d):
    """The tiles around the embedding points, 50 m wide at zoom 10."""
    tile = lambda c: (F.floor(F.col(c) / 50) + 512)
    return raster.tile_plan(_points(spark, d).select(tile("x").alias("tx"), tile("y").alias("ty")), 10).select(F.col("z").cast("int").alias("z"), "x", "y")


def stroke_lengths(spark, d):
    return raster.stroke_pixels(_streets(spark, d), 2.0, 25.0).select("x", "y", F.round("length", 5).alias("length"))


def polygon_fill(spark, d):
    return raster.fill(_boxes(spark, d), 7.0)


def blurred(spark, d):
    return raster.blurred(cells(spark, d), [0.5, 0.25]).select("x", "y", F.round("value", 6).alias("value"))


def distance_decay(spark, d):
    return table(spark, d, "part").select("p_partkey", F.round(geo.half_way_decay(F.col("p_retailprice")), 9).alias("factor"))


def component_lengths(spark, d):
    """Edges and length of each component, the longest first (of equals the smaller root)."""
    e = _edges(spark, d).where("w > 40")
    named = e.join(graph.components(e).withColumnRenamed("node", "a"), "a")
    return named.groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.sum("w").alias("length")).orderBy(F.desc("length"), "component")


def length_tail(spark, d):
    """Links by kind: how many, the 99th percentile and the longest."""
    l = table(spark, d, "lineitem")  # noqa: E741
    tail = l.groupBy("l_returnflag", F.col("l_extendedprice").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    return tail.groupBy("l_returnflag").agg(F.sum("n").alias("links"), F.round(F.expr("percentile(v, 0.99, n)"), 4).alias("p99"), F.max("v").alias("longest"))


def cell_shares(spark, d):
    """Per cell of 100 m the share of weight that is demoted; the 90th, 99th and worst of the cells."""
    p = _grid(spark, d).select(F.floor(F.col("x") / 100).alias("cx"), F.floor(F.col("y") / 100).alias("cy"), "w", (F.col("rid") % 3 == 0).alias("demoted"))
    share = p.groupBy("cx", "cy").agg((F.sum(F.when(F.col("demoted"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("share"), F.sum("w").alias("w")).where("w >= 2")
    return share.agg(F.round(stats.nearest_rank("share", 0.9), 9).alias("p90"), F.round(stats.nearest_rank("share", 0.99), 9).alias("p99"), F.round(F.max("share"), 9).alias("worst"), F.count(F.lit(1)).alias("cells"))


def trip_legs(spark, d):
    l = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_returnflag", "l_quantity")).alias("m"))  # noqa: E741
    s = l.select("l_orderkey", "l_linenumber", F.col("m.l_returnflag").alias("line"), F.col("m.l_quantity").alias("seconds"), F.when(F.col("m.l_partkey") % 4 == 0, F.lit(60.0)).otherwise(0.0).alias("wait"))
    return windows.merged_legs(s, ["l_orderkey"], "l_linenumber").select("l_orderkey", "leg", "first", "last", "seconds")


def passed_points(spark, d):
    """For each street the points within 30 m of it, and where along it they are passed."""
    size = 30.0
    p = spatial._cells(_points(spark, d, "id"), "x", "y", size)
    s = spatial._segment_cells(_streets(spark, d), size, size)
    c = [F.col(k) for k in ("x", "y", "ax", "ay", "bx", "by")]
    hit = p.join(s, ["_cx", "_cy"]).where(geo.segment_distance(*c) <= size)
    return hit.select("seg", "id", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), geo.along(*c))), 6).alias("at"))


def confidence_products(spark, d):
    """How sure a placement is: independent doubts multiply."""
    p = table(spark, d, "part")
    parts = [F.when(F.col("p_size") > 25, 0.9).otherwise(0.6), F.when(F.col("p_partkey") % 3 == 0, 0.5).otherwise(1.0), 1 - F.col("p_size") / 100.0]
    return p.select("p_partkey", F.round(parts[0] * parts[1] * parts[2], 9).alias("confidence"))


QUERIES = {
    "tile_plan": tile_plan, "stroke_lengths": stroke_lengths, "polygon_fill": polygon_fill, "blurred_cells": blurred, "distance_decay": distance_decay, "component_lengths": component_lengths,
    "length_tail": length_tail, "cell_shares": cell_shares, "trip_legs": trip_legs, "passed_points": passed_points, "confidence_products": confidence_products,
}

ORACLES = {
    "tile_plan": """WITH t AS (SELECT floor(embedding[1]::DOUBLE * 1000 / 50)::BIGINT + 512 AS x, floor(embedding[2]::DOUBLE * 1000 / 50)::BIGINT + 512 AS y FROM embeddings),
b AS (SELECT unnest(range(x0, x1 + 1)) AS x, y0, y1 FROM (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM t)), c AS (SELECT x, unnest(range(y0, y1 + 1)) AS y FROM b)
SELECT DISTINCT CAST(z AS INTEGER) AS z, x >> CAST(10 - z AS INTEGER) AS x, y >> CAST(10 - z AS INTEGER) AS y FROM c, range(11) r(z)""",
    "stroke_lengths": f"""WITH {_S}, n AS (SELECT *, sqrt(pow(bx - ax, 2) + pow("by" - ay, 2)) AS l FROM s), m AS (SELECT *, CAST(greatest(1, ceil(l / 2.0)) AS INTEGER) AS n FROM n),
i AS (SELECT *, unnest(range(0, n)) AS i FROM m) SELECT CAST(floor((ax + (i + 0.5::DOUBLE) / n * (bx - ax)) / 25) AS BIGINT) AS x, CAST(floor((ay + (i + 0.5::DOUBLE) / n * ("by" - ay)) / 25) AS BIGINT) AS y, round(sum(l / n), 5) AS length FROM i GROUP BY 1, 2""",
    "polygon_fill": f"""WITH {_P}, g AS (SELECT CAST(i AS BIGINT) AS x, CAST(j AS BIGINT) AS y, (i + 0.5::DOUBLE) * 7 AS px, (j + 0.5::DOUBLE) * 7 AS py FROM range(-60, 61) a(i), range(-60, 61) b(j))
SELECT poly, x, y FROM g JOIN pe ON (y1 > py) <> (y2 > py) AND px < x1 + (py - y1) * (x2 - x1) / (y2 - y1) GROUP BY poly, x, y HAVING count(*) % 2 = 1""",
    "blurred_cells": f"""WITH {_CELLS}, k AS (SELECT * FROM (VALUES (-1, 0.25::DOUBLE), (0, 0.5), (1, 0.25)) t(o, w)),
h AS (SELECT a.x, a.y, CASE WHEN any_value(a.value) IS NOT NULL THEN sum(b.value * w) / sum(CASE WHEN b.value IS NOT NULL THEN w END) END AS value FROM c a JOIN k ON true LEFT JOIN c b ON b.x = a.x + o AND b.y = a.y GROUP BY a.x, a.y),
v AS (SELECT a.x, a.y, CASE WHEN any_value(a.value) IS NOT NULL THEN sum(b.value * w) / sum(CASE WHEN b.value IS NOT NULL THEN w END) END AS value FROM h a JOIN k ON true LEFT JOIN h b ON b.x = a.x AND b.y = a.y + o GROUP BY a.x, a.y) SELECT x, y, round(value, 6) AS value FROM v""",
    "distance_decay": "SELECT p_partkey, round(0.25::DOUBLE + 0.75::DOUBLE * exp(-p_retailprice / 1500), 9) AS factor FROM part",
    "component_lengths": f"""WITH RECURSIVE {_EDGES}, h AS (SELECT a, b FROM bw WHERE w > 40), r AS (SELECT a AS node, a AS top FROM h UNION SELECT h.b, r.top FROM r JOIN h ON h.a = r.node), m AS (SELECT node, min(top) AS component FROM r GROUP BY node)
SELECT component, count(*) AS edges, sum(w) AS length FROM ed JOIN m ON m.node = ed.a WHERE w > 40 GROUP BY component""",
    "length_tail": "SELECT l_returnflag, count(*) AS links, round(quantile_cont(l_extendedprice, 0.99), 4) AS p99, max(l_extendedprice) AS longest FROM lineitem GROUP BY l_returnflag",
    "cell_shares": f"""WITH {_G}, s AS (SELECT sum(CASE WHEN id % 3 = 0 THEN w ELSE 0 END) / sum(w) AS s FROM g GROUP BY floor(x / 100), floor(y / 100) HAVING sum(w) >= 2)
SELECT round(quantile_disc(s, 0.9), 9) AS p90, round(quantile_disc(s, 0.99), 9) AS p99, round(max(s), 9) AS worst, count(*) AS cells FROM s""",
    "trip_legs": """WITH l AS (SELECT l_orderkey, l_linenumber AS i, arg_min(l_returnflag, k) AS line, arg_min(l_quantity, k) AS s, CASE WHEN min(l_partkey) % 4 = 0 THEN 60.0::DOUBLE ELSE 0 END AS wait FROM (SELECT *, (l_partkey, l_returnflag, l_quantity) AS k FROM lineitem) GROUP BY l_orderkey, l_linenumber),
n AS (SELECT *, CASE WHEN lag(line) OVER w = line AND wait = 0 THEN 0 ELSE 1 END AS new FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY i)), g AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY i ROWS UNBOUNDED PRECEDING) AS leg FROM n)
SELECT l_orderkey, CAST(leg AS BIGINT) AS leg, min(i) AS first, max(i) AS last, sum(wait + s) AS seconds FROM g GROUP BY l_orderkey, leg""",
    "passed_points": f"""WITH {_E}, {_S}, t AS (SELECT id, seg, x, y, ax, ay, bx, "by", greatest(0, least(1, ((x - ax) * (bx - ax) + (y - ay) * ("by" - ay)) / ((bx - ax) * (bx - ax) + ("by" - ay) * ("by" - ay)))) AS t FROM e, s)
SELECT seg, id, round(t, 6) AS at FROM t WHERE sqrt(pow(x - (ax + t * (bx - ax)), 2) + pow(y - (ay + t * ("by" - ay)), 2)) <= 30""",
    "confidence_products": "SELECT p_partkey, round(CASE WHEN p_size > 25 THEN 0.9::DOUBLE ELSE 0.6::DOUBLE END * CASE WHEN p_partkey % 3 = 0 THEN 0.5::DOUBLE ELSE 1 END * (1 - p_size / 100.0::DOUBLE), 9) AS confidence FROM part",
}
