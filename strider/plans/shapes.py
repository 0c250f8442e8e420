"""Denser and simpler lines, and rows of a box read by their statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.operators import shapes
from strider.plans import lines as drawn
from strider.sources import files
from strider.sources.tables import table


def densified_lines(spark, d):
    return shapes.densified(drawn.ways(spark, d), 10.0).select("line", "i", "k", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def _tracks(spark, d):
    """A track a user: events in order of time, east by hours, north by value."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("line"), F.col("event_id").alias("i"), (F.unix_micros(F.col("ts").cast("timestamp")) / 3.6e9 % 1000).alias("x"), F.col("value").alias("y"))


def simplified_lines(spark, d):
    return shapes.simplified(_tracks(spark, d), 15.0).select("line", "i")


def boxed_lines(spark, d):
    found = files.read_box(spark, f"{d}/lineitem.parquet", ("l_quantity", "l_extendedprice"), (10.0, 20000.0, 20.0, 40000.0))
    return found.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


QUERIES = {"densified_lines": densified_lines, "simplified_lines": simplified_lines, "boxed_lines": boxed_lines}

ORACLES = {
    "densified_lines": f"""WITH {drawn._TABLES}, {drawn._pieces("p", "wy")}
SELECT line, i, k::INTEGER AS k, round(ax + k / n * (ex - ax), 6) AS x, round(ay + k / n * (ey - ay), 6) AS y FROM (SELECT *, unnest(range(0, n)) AS k FROM (SELECT *, greatest(1, ceil(meters / 10e0)::BIGINT) AS n FROM p))
UNION ALL SELECT line, max(i), 0, round(arg_max(x, i), 6), round(arg_max(y, i), 6) FROM wy GROUP BY line""",
    # Chords are split at their farthest vertex, one depth a step.
    "simplified_lines": """WITH RECURSIVE tr AS (SELECT user_id AS line, event_id AS i, epoch_us(ts) / 3.6e9 % 1000e0 AS x, value AS y FROM events),
l AS (SELECT line, list({'i': i, 'x': x, 'y': y} ORDER BY i) AS vs FROM tr GROUP BY line),
s AS (SELECT line, vs, 1::BIGINT AS lo, len(vs)::BIGINT AS hi FROM l UNION ALL
    SELECT line, vs, unnest([lo, at_]), unnest([at_, hi]) FROM (SELECT *, lo + list_position(ds, list_max(ds)) AS at_ FROM (SELECT line, vs, lo, hi, [sqrt((p.x - (vs[lo].x + greatest(0e0, least(1e0, CASE WHEN c > 0 THEN ((p.x - vs[lo].x) * (vs[hi].x - vs[lo].x) + (p.y - vs[lo].y) * (vs[hi].y - vs[lo].y)) / c ELSE 0 END)) * (vs[hi].x - vs[lo].x))) ** 2
        + (p.y - (vs[lo].y + greatest(0e0, least(1e0, CASE WHEN c > 0 THEN ((p.x - vs[lo].x) * (vs[hi].x - vs[lo].x) + (p.y - vs[lo].y) * (vs[hi].y - vs[lo].y)) / c ELSE 0 END)) * (vs[hi].y - vs[lo].y))) ** 2) FOR p IN vs[lo + 1:hi - 1]] AS ds
        FROM (SELECT *, (vs[hi].x - vs[lo].x) ** 2 + (vs[hi].y - vs[lo].y) ** 2 AS c FROM s WHERE hi - lo > 1)) WHERE list_max(ds) > 15))
SELECT DISTINCT line, unnest([vs[lo].i, vs[hi].i]) AS i FROM s""",
    "boxed_lines": "SELECT l_suppkey, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem WHERE l_quantity > 10 AND l_quantity < 20 AND l_extendedprice > 20000 AND l_extendedprice < 40000 GROUP BY l_suppkey",
}
