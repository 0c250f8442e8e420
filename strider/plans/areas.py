"""Areas that meet areas."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.operators import areas
from strider.plans.spatial_graph import _boxes
from strider.sources.tables import table


def _lots(spark, d):
    """A triangle a part, now and then small enough to lie inside an area."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("poly"), ((F.col("p_partkey") * 37) % 801 - 400).cast("double").alias("x"), ((F.col("p_partkey") * 91) % 797 - 398).cast("double").alias("y"), (F.col("p_size") + 1.0).alias("w"))
    at = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    return p.select("poly", F.array(at(F.lit(0.0), F.lit(0.0)), at(F.col("w"), F.col("w") / 4), at(F.col("w") / 2, F.col("w"))).alias("ring"))


def intersecting_areas(spark, d):
    return areas.intersecting(_boxes(spark, d), _lots(spark, d), 40.0)


def union_areas(spark, d):
    """The areas of each nation's suppliers as one."""
    grp = table(spark, d, "supplier").select(F.col("s_suppkey").alias("poly"), F.col("s_nationkey").alias("grp"))
    return areas.union_areas(_boxes(spark, d).join(grp, "poly"), 30.0).select("grp", F.round("area", 3).alias("area"))


QUERIES = {"intersecting_areas": intersecting_areas, "union_areas": union_areas}

ORACLES = {
    "intersecting_areas": f"""WITH s AS (SELECT s_suppkey AS poly, (s_suppkey * 53) % 600 - 300e0 AS x, (s_suppkey * 29) % 600 - 300e0 AS y FROM supplier),
p AS (SELECT p_partkey AS poly, (p_partkey * 37) % 801 - 400e0 AS x, (p_partkey * 91) % 797 - 398e0 AS y, p_size + 1e0 AS w FROM part),
r AS (SELECT poly, [{{'x': x - 40, 'y': y - 25}}, {{'x': x + 35, 'y': y - 30}}, {{'x': x + 45, 'y': y + 20}}, {{'x': x, 'y': y + 50}}, {{'x': x - 38, 'y': y + 22}}] AS v FROM s),
q AS (SELECT poly, [{{'x': x, 'y': y}}, {{'x': x + w, 'y': y + w / 4}}, {{'x': x + w / 2, 'y': y + w}}] AS v FROM p),
e AS (SELECT poly, v[i].x AS ax, v[i].y AS ay, v[i % 5 + 1].x AS bx, v[i % 5 + 1].y AS "by" FROM r, range(1, 6) t(i)), f AS (SELECT poly, v[i].x AS cx, v[i].y AS cy, v[i % 3 + 1].x AS dx, v[i % 3 + 1].y AS dy FROM q, range(1, 4) t(i)),
n AS (SELECT r.poly AS a, q.poly AS b, r.v AS rv, q.v AS qv FROM r JOIN q ON list_min([z.x FOR z IN r.v]) <= list_max([z.x FOR z IN q.v]) AND list_min([z.x FOR z IN q.v]) <= list_max([z.x FOR z IN r.v])
    AND list_min([z.y FOR z IN r.v]) <= list_max([z.y FOR z IN q.v]) AND list_min([z.y FOR z IN q.v]) <= list_max([z.y FOR z IN r.v])),
x AS (SELECT DISTINCT a, b FROM n JOIN e ON e.poly = a JOIN f ON f.poly = b WHERE least(ax, bx) <= greatest(cx, dx) AND least(cx, dx) <= greatest(ax, bx) AND least(ay, "by") <= greatest(cy, dy) AND least(cy, dy) <= greatest(ay, "by")
    AND sign((bx - ax) * (cy - ay) - ("by" - ay) * (cx - ax)) * sign((bx - ax) * (dy - ay) - ("by" - ay) * (dx - ax)) <= 0 AND sign((dx - cx) * (ay - cy) - (dy - cy) * (ax - cx)) * sign((dx - cx) * ("by" - cy) - (dy - cy) * (bx - cx)) <= 0),
i AS (SELECT a, b FROM n JOIN e ON e.poly = a WHERE (ay > qv[1].y) <> ("by" > qv[1].y) AND qv[1].x < ax + (qv[1].y - ay) * (bx - ax) / ("by" - ay) GROUP BY a, b HAVING count(*) % 2 = 1),
j AS (SELECT a, b FROM n JOIN f ON f.poly = b WHERE (cy > rv[1].y) <> (dy > rv[1].y) AND rv[1].x < cx + (rv[1].y - cy) * (dx - cx) / (dy - cy) GROUP BY a, b HAVING count(*) % 2 = 1)
SELECT a, b FROM x UNION SELECT a, b FROM i UNION SELECT a, b FROM j""",
    # By slabs between all corners and crossings: in each the union's height is a straight line, so its middle tells its area.
    "union_areas": """WITH s AS (SELECT s_nationkey AS grp, s_suppkey AS poly, (s_suppkey * 53) % 600 - 300e0 AS x, (s_suppkey * 29) % 600 - 300e0 AS y FROM supplier),
e AS (SELECT grp, poly, unnest([x - 40, x + 35, x + 45, x, x - 38]) AS x1, unnest([y - 25, y - 30, y + 20, y + 50, y + 22]) AS y1, unnest([x + 35, x + 45, x, x - 38, x - 40]) AS x2, unnest([y - 30, y + 20, y + 50, y + 22, y - 25]) AS y2 FROM s),
c AS (SELECT grp, x1 + t * (x2 - x1) AS x FROM (SELECT a.grp, a.x1, a.x2, ((b.x1 - a.x1) * (b.y2 - b.y1) - (b.y1 - a.y1) * (b.x2 - b.x1)) / ((a.x2 - a.x1) * (b.y2 - b.y1) - (a.y2 - a.y1) * (b.x2 - b.x1)) AS t
    FROM e a JOIN e b ON a.grp = b.grp AND a.poly < b.poly WHERE (a.x2 - a.x1) * (b.y2 - b.y1) <> (a.y2 - a.y1) * (b.x2 - b.x1)) WHERE t BETWEEN 0 AND 1),
v AS (SELECT grp, x FROM c UNION SELECT grp, x1 FROM e), b AS (SELECT grp, x AS xa, lead(x) OVER (PARTITION BY grp ORDER BY x) AS xb FROM v),
h AS (SELECT b.grp, xa, xb, poly, y1 + ((xa + xb) / 2 - x1) * (y2 - y1) / (x2 - x1) AS y FROM b JOIN e ON b.grp = e.grp AND (x1 > (xa + xb) / 2) <> (x2 > (xa + xb) / 2) WHERE xb > xa),
p AS (SELECT grp, xa, xb, y AS lo, lead(y) OVER w AS hi, row_number() OVER w AS r FROM h WINDOW w AS (PARTITION BY grp, xa, poly ORDER BY y)),
m AS (SELECT grp, xa, xb, hi, greatest(lo, coalesce(max(hi) OVER (PARTITION BY grp, xa ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo)) AS lo FROM p WHERE r % 2 = 1)
SELECT grp, round(sum((xb - xa) * greatest(0, hi - lo)), 3) AS area FROM m GROUP BY grp""",
}
