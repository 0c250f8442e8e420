"""Heights of returns over ground, and lines in the shade of what stands beside them.

Lines of a supply are returns of a flight; streets stand as in `lines`, and a part is a building of six corners beside
one. A nation is a place of the sun: its region the season, its key the hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from strider.operators import shade
from strider.plans import lines as drawn
from strider.sources.tables import table

LATITUDE, LOW, LONGEST = 40.7, 0.5, 150.0


def returns(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "ground").when(F.col("l_returnflag") == "N", "surface").otherwise("other")
    return table(spark, d, "lineitem").select((F.col("l_orderkey") % 509 * 4.0).alias("x"), (F.col("l_partkey") * 4.0).alias("y"), (F.col("l_quantity") * 0.37).alias("z"), kind.alias("kind"))


def surface_heights(spark, d):
    s = table(spark, d, "supplier").select((F.col("s_suppkey") % 251).alias("cx"), (F.col("s_suppkey") * 7).alias("cy"), F.col("s_nationkey").cast("double").alias("ground"))
    return shade.heights(returns(spark, d), 8.0, s).select("cx", "cy", F.round("height", 6).alias("height"), F.round("ground", 6).alias("ground"))


def suns(spark, d):
    """bin, east, north, reach of the places above the horizon."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("bin"), (F.col("n_regionkey") * 11.72 - 23.44).alias("declination"), (F.col("n_nationkey") * 6.5 - 78).alias("hour"))
    up, east, north = shade.sun(F.lit(LATITUDE), F.col("declination"), F.col("hour"))
    n = n.select("bin", up.alias("up"), east.alias("east"), north.alias("north")).where(F.col("up") > LOW)
    return n.select("bin", "east", "north", (1 / F.tan(F.radians("up"))).alias("reach"))


def buildings(spark, d):
    p = table(spark, d, "part").withColumn("x", F.col("p_partkey") % 64 * 300.0 + 20 + F.col("p_size") * 3).withColumn("y", F.floor(F.col("p_partkey") / 64) * 300.0 - 50 + F.col("p_retailprice") % 37)
    corners = [(0, 0), (31, 3), (29, 24), (17, 22), (16, 11), (-2, 9)]
    return p.select(F.col("p_partkey").alias("poly"), F.array(*[F.struct((F.col("x") + a).alias("x"), (F.col("y") + b).alias("y")) for a, b in corners]).alias("ring"), (F.col("p_size") - 5.0).alias("height"))


def shaded_lines(spark, d):
    return shade.line_shade(drawn.streets(spark, d).select("line", "i", "x", "y"), buildings(spark, d), suns(spark, d), LONGEST)


def instants(spark, d):
    """id, line, elevation, declination, hour, east, north: an order is a walk along its customer's street."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("line"), F.dayofyear("o_orderdate").alias("day"), (F.floor(F.col("o_totalprice") * 100) % 1440 / 4 - 180).alias("hour"))
    o = o.withColumn("declination", shade.MOST_DECLINATION * F.sin(F.radians((F.col("day") - 81) * 360 / 365)))
    up, east, north = shade.sun(F.lit(LATITUDE), F.col("declination"), F.col("hour"))
    return o.select("id", "line", "hour", "declination", up.alias("elevation"), east.alias("east"), north.alias("north"))


def bins(spark, d):
    n = table(spark, d, "nation").join(suns(spark, d), F.col("n_nationkey") == F.col("bin"))
    return n.select("bin", shade.season_band(F.col("n_regionkey") * 11.72 - 23.44).alias("season"), (F.col("n_nationkey") * 6.5 - 78).alias("hour"))


def shade_blends(spark, d):
    return shade.blends(instants(spark, d), bins(spark, d)).select("id", "nearest", "second", F.round("w1", 9).alias("w1"), F.round("w2", 9).alias("w2"))


def walk_shades(spark, d):
    i = instants(spark, d)
    return shade.blended(i, shade.blends(i, bins(spark, d)), shaded_lines(spark, d)).select("id", "line", F.round("shade", 6).alias("shade"))


def shed_shades(spark, d):
    """A shed of 2 to 8 m along each customer's street, with its deck 4 m above."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("line"), (F.col("c_nationkey") % 6 / 5).alias("covered"), F.radians(F.abs("c_acctbal") % 180).alias("bearing"), (2 + F.col("c_custkey") % 7).alias("depth"))
    i = instants(spark, d).join(c, "line")
    across = 4.0 / F.tan(F.radians(F.greatest(F.col("elevation"), F.lit(3.0))))
    out = shade.shed_shade(F.col("covered"), across, F.atan2(-F.col("east"), -F.col("north")), F.col("bearing"), F.col("depth"))
    return i.select("id", F.round(out, 6).alias("shade"))


QUERIES = {"surface_heights": surface_heights, "shaded_lines": shaded_lines, "shade_blends": shade_blends, "walk_shades": walk_shades, "shed_shades": shed_shades}

_INSTANTS = """o AS (SELECT o_orderkey AS id, o_custkey AS line, floor(o_totalprice * 100)::BIGINT % 1440 / 4 - 180 AS hour, 23.44e0 * sin(radians((dayofyear(o_orderdate) - 81) * 360e0 / 365)) AS decl FROM orders),
oa AS (SELECT *, radians(decl) AS de, radians(hour) AS ho, radians(40.7e0) AS la FROM o),
ot AS (SELECT id, line, hour, decl, degrees(asin(sin(la) * sin(de) + cos(la) * cos(de) * cos(ho))) AS up, -cos(de) * sin(ho) AS e, cos(la) * sin(de) - sin(la) * cos(de) * cos(ho) AS n FROM oa)"""

_BLENDS = f"""{_INSTANTS},
bn AS (SELECT n_nationkey AS bin, n_nationkey * 6.5e0 - 78 AS hour, n_regionkey * 11.72e0 - 23.44e0 AS decl FROM nation),
bs AS (SELECT bin, hour, least(5, greatest(0, floor((decl + 23.44e0) / 46.88e0 * 6)))::INTEGER AS season FROM bn
    WHERE degrees(asin(sin(radians(40.7e0)) * sin(radians(decl)) + cos(radians(40.7e0)) * cos(radians(decl)) * cos(radians(hour)))) > 0.5),
os AS (SELECT *, least(5, greatest(0, floor((decl + 23.44e0) / 46.88e0 * 6)))::INTEGER AS season FROM ot WHERE up > 0.5),
cd AS (SELECT os.id, os.line, bs.bin, abs(bs.hour - os.hour) AS gap FROM os JOIN bs ON os.season = bs.season OR os.season NOT IN (SELECT season FROM bs)),
rk AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gap, bin) AS r FROM cd),
pq AS (SELECT id, line, max(CASE r WHEN 1 THEN bin END) AS p, max(CASE r WHEN 2 THEN bin END) AS q, max(CASE r WHEN 1 THEN gap END) AS dp, max(CASE r WHEN 2 THEN gap END) AS dq FROM rk WHERE r < 3 GROUP BY ALL),
mx AS (SELECT id, line, p AS nearest, CASE WHEN q IS NULL OR dp + dq = 0 THEN p ELSE q END AS second, CASE WHEN q IS NULL OR dp + dq = 0 THEN 1 ELSE dq / (dp + dq) END AS w1, CASE WHEN q IS NULL OR dp + dq = 0 THEN 0 ELSE dp / (dp + dq) END AS w2 FROM pq)"""

ORACLES = {
    # The nearest known cell by all that lie in the nine blocks of 64 cells around.
    "surface_heights": """WITH b AS (SELECT floor((l_orderkey % 509) * 4e0 / 8)::BIGINT AS cx, floor(l_partkey * 4e0 / 8)::BIGINT AS cy, max(CASE WHEN l_returnflag = 'N' THEN l_quantity * 0.37e0 END) AS top,
    sum(CASE WHEN l_returnflag = 'R' THEN round(l_quantity * 0.37e0 * 10) END) / count(CASE WHEN l_returnflag = 'R' THEN 1 END) / 10 AS mean FROM lineitem GROUP BY 1, 2),
s AS (SELECT s_suppkey % 251 AS cx, s_suppkey * 7 AS cy, s_nationkey::DOUBLE AS staged FROM supplier),
k AS (SELECT cx, cy, coalesce(staged, mean) AS ground FROM b FULL JOIN s USING (cx, cy) WHERE coalesce(staged, mean) IS NOT NULL),
w AS (SELECT cx, cy, top, ground FROM b LEFT JOIN k USING (cx, cy) WHERE top IS NOT NULL),
t AS (SELECT *, cx // 64 + unnest([-1, -1, -1, 0, 0, 0, 1, 1, 1]) AS u, cy // 64 + unnest([-1, 0, 1, -1, 0, 1, -1, 0, 1]) AS v FROM k),
n AS (SELECT w.cx, w.cy, arg_min(t.ground, (abs(t.cx - w.cx) + abs(t.cy - w.cy), t.cy, t.cx)) AS near FROM w JOIN t ON w.cx // 64 = t.u AND w.cy // 64 = t.v WHERE w.ground IS NULL AND abs(t.cx - w.cx) + abs(t.cy - w.cy) <= 64 GROUP BY ALL)
SELECT cx, cy, round(top - coalesce(ground, near), 6) AS height, round(coalesce(ground, near), 6) AS ground FROM w LEFT JOIN n USING (cx, cy)""",
    "shaded_lines": """WITH v AS (SELECT c_custkey AS line, i, (c_custkey % 64) * 300e0 + i * 60 AS x, floor(c_custkey / 64) * 300e0 + CASE i WHEN 1 THEN abs(c_acctbal) % 25 WHEN 3 THEN (abs(c_acctbal) % 25) / 2 ELSE 0 END AS y FROM customer, range(0, 4) r(i)),
p AS (SELECT *, lead(x) OVER w AS bx, lead(y) OVER w AS by_ FROM v WINDOW w AS (PARTITION BY line ORDER BY i)),
q AS (SELECT line, x + k / n * (bx - x) AS x, y + k / n * (by_ - y) AS y FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM (SELECT *, greatest(1, ceil(sqrt((bx - x) ** 2 + (by_ - y) ** 2) / 5)::BIGINT) AS n FROM p WHERE bx IS NOT NULL)) UNION ALL SELECT line, x, y FROM v WHERE i = 0),
pr AS (SELECT line, floor(x / 5)::BIGINT AS cx, floor(y / 5)::BIGINT AS cy, count(*) AS k FROM q GROUP BY ALL),
c AS (SELECT DISTINCT cx, cy, (cx + 0.5e0) * 5 AS x, (cy + 0.5e0) * 5 AS y FROM pr),
h AS (SELECT n_nationkey AS bin, radians(n_regionkey * 11.72e0 - 23.44e0) AS de, radians(n_nationkey * 6.5e0 - 78) AS ho, radians(40.7e0) AS la FROM nation),
g AS (SELECT bin, asin(sin(la) * sin(de) + cos(la) * cos(de) * cos(ho)) AS up, -cos(de) * sin(ho) AS e, cos(la) * sin(de) - sin(la) * cos(de) * cos(ho) AS n FROM h),
s AS (SELECT bin, -e / sqrt(e * e + n * n) AS east, -n / sqrt(e * e + n * n) AS north, 1 / tan(up) AS reach FROM g WHERE degrees(up) > 0.5),
b AS (SELECT p_partkey AS poly, (p_partkey % 64) * 300e0 + 20 + p_size * 3 AS x, floor(p_partkey / 64) * 300e0 - 50 + p_retailprice % 37 AS y, p_size - 5e0 AS height FROM part WHERE p_size > 5),
r AS (SELECT poly, height, unnest([(x, y), (x + 31, y + 3), (x + 29, y + 24), (x + 17, y + 22), (x + 16, y + 11), (x - 2, y + 9)]) AS a, unnest([(x + 31, y + 3), (x + 29, y + 24), (x + 17, y + 22), (x + 16, y + 11), (x - 2, y + 9), (x, y)]) AS z FROM b),
ed AS (SELECT poly, height, a[1] AS x1, a[2] AS y1, z[1] AS x2, z[2] AS y2 FROM r),
d AS (SELECT ed.*, bin, least(height * reach, 150) * east AS dx, least(height * reach, 150) * north AS dy FROM ed, s),
dt AS (SELECT *, unnest(range(floor(least(x1, x2, x1 + dx, x2 + dx) / 100)::BIGINT, floor(greatest(x1, x2, x1 + dx, x2 + dx) / 100)::BIGINT + 1)) AS tx FROM d),
du AS (SELECT *, unnest(range(floor(least(y1, y2, y1 + dy, y2 + dy) / 100)::BIGINT, floor(greatest(y1, y2, y1 + dy, y2 + dy) / 100)::BIGINT + 1)) AS ty, (x2 - x1) * dy - (y2 - y1) * dx AS det FROM dt),
sw AS (SELECT cx, cy, bin FROM c JOIN du ON floor(c.x / 100) = tx AND floor(c.y / 100) = ty WHERE det <> 0 AND ((x - x1) * dy - (y - y1) * dx) / det BETWEEN 0 AND 1 AND ((x2 - x1) * (y - y1) - (y2 - y1) * (x - x1)) / det BETWEEN 0 AND 1),
et AS (SELECT *, unnest(range(floor(least(y1, y2) / 10)::BIGINT, floor(greatest(y1, y2) / 10)::BIGINT + 1)) AS ty FROM ed),
un AS (SELECT DISTINCT cx, cy FROM (SELECT cx, cy, poly FROM c JOIN et ON floor(c.y / 10) = ty WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) GROUP BY ALL HAVING count(*) % 2 = 1)),
dk AS (SELECT DISTINCT * FROM (SELECT cx, cy, bin FROM sw UNION ALL SELECT cx, cy, bin FROM un, s)),
tt AS (SELECT line, sum(k) AS n FROM pr GROUP BY line)
SELECT line, bin, floor(sum(k)::DOUBLE / any_value(tt.n) * 255 + 0.5)::INTEGER AS shade FROM pr JOIN dk USING (cx, cy) JOIN tt USING (line) GROUP BY line, bin HAVING shade > 0""",
}
ORACLES["shade_blends"] = f"WITH {_BLENDS} SELECT id, nearest, second, round(w1, 9) AS w1, round(w2, 9) AS w2 FROM mx"
ORACLES["walk_shades"] = f"""WITH {_BLENDS}, sl AS ({ORACLES["shaded_lines"]})
SELECT mx.id, mx.line, round(w1 * coalesce(a.shade, 0) + w2 * coalesce(b.shade, 0), 6) AS shade FROM mx LEFT JOIN sl a ON a.line = mx.line AND a.bin = nearest LEFT JOIN sl b ON b.line = mx.line AND b.bin = second"""
ORACLES["shed_shades"] = f"""WITH {_INSTANTS}, c AS (SELECT c_custkey AS line, (c_nationkey % 6) / 5 AS covered, radians(abs(c_acctbal) % 180) AS bearing, 2 + c_custkey % 7 AS depth FROM customer)
SELECT id, round(CASE WHEN covered > 0 THEN covered * greatest(0.15e0, 1 - 4 / tan(radians(greatest(up, 3))) * abs(sin(atan2(e, n) - bearing)) / depth) ELSE 0 END, 6) AS shade FROM ot JOIN c USING (line)"""
