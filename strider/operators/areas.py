"""Polygons that meet polygons, and their unions: edges meet on grid cells, what lies inside by a point of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.operators.spatial import point_in_polygon, polygon_edges
from strider.operators.stored import stored


def _turn(ax: Column, ay: Column, bx: Column, by: Column, px: Column, py: Column) -> Column:
    """The sign of the turn from a over b to p: 1 left, -1 right, 0 straight."""
    return F.signum((bx - ax) * (py - ay) - (by - ay) * (px - ax))


def segments_meet(a: list[Column], b: list[Column]) -> Column:
    """Whether two segments (x1, y1, x2, y2) share a point; ends that touch and stretches on one line count."""
    span = lambda s, i: (F.least(s[i], s[i + 2]), F.greatest(s[i], s[i + 2]))
    boxes = F.lit(True)
    for i in (0, 1):
        (alo, ahi), (blo, bhi) = span(a, i), span(b, i)
        boxes = boxes & (alo <= bhi) & (blo <= ahi)
    return boxes & (_turn(*a, *b[:2]) * _turn(*a, *b[2:]) <= 0) & (_turn(*b, *a[:2]) * _turn(*b, *a[2:]) <= 0)


def intersecting(left: DataFrame, right: DataFrame, cell: float) -> DataFrame:
    """a, b: polygons of left and right (poly, ring of (x, y)) that share a point: their edges meet, or one holds the other.

    Edges of a cell meet edges of the cell; a pair is told once, whatever the number of its crossings. Points are tested
    against the polygons of their cell, so no polygon meets all others. Polygons with the very same rings are one until the
    pairs are known; only then does each pair stand for all of its polygons."""

    def shapes(df: DataFrame, p: str) -> DataFrame:
        each = df.groupBy("poly").agg(F.sort_array(F.collect_list("ring")).alias("rings"))
        return each.withColumn(p, F.min("poly").over(Window.partitionBy("rings")))

    def edges(df: DataFrame, p: str) -> DataFrame:
        e = polygon_edges(df)
        bounds = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
        e = e.withColumn("_cx", bounds("x1", "x2")).withColumn("_cy", bounds("y1", "y2"))
        return e.select(F.col("poly").alias(p), "_cx", "_cy", *[F.col(c).alias(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")])

    every = {"a": shapes(left, "a"), "b": shapes(right, "b")}
    one, other = (every[p].where(F.col("poly") == F.col(p)).select("poly", F.explode("rings").alias("ring")) for p in "ab")
    sides = [[F.col(f"{p}{c}") for c in ("x1", "y1", "x2", "y2")] for p in "ab"]
    crossed = edges(one, "a").join(edges(other, "b").hint("merge"), ["_cx", "_cy"]).where(segments_meet(*sides)).select("a", "b")
    corner = lambda df: df.select(F.col("poly").alias("id"), F.get("ring", F.lit(0))["x"].alias("x"), F.get("ring", F.lit(0))["y"].alias("y"))
    inside = point_in_polygon(corner(one), other, cell).select(F.col("id").alias("a"), F.col("poly").alias("b"))
    around = point_in_polygon(corner(other), one, cell).select(F.col("poly").alias("a"), F.col("id").alias("b"))
    met = crossed.unionByName(inside).unionByName(around).distinct()
    for p in "ba":
        met = met.join(every[p].select(p, F.col("poly").alias(f"_{p}")).hint("merge"), p)
    return met.select(F.col("_a").alias("a"), F.col("_b").alias("b"))


def union_outline(polygons: DataFrame, cell: float) -> DataFrame:
    """grp, poly, x1, y1, x2, y2: the outline of the union of each group's polygons (grp, poly, ring: simple, either way round), as
    directed pieces with the union on their left, each with the polygon it comes from.

    Edges are cut where they meet edges of other polygons of the group (met on grid cells); a piece stays unless its middle
    lies inside another. Of pieces that coincide (to a millionth) one stays if they run the same way, none if they run
    against each other, as there is area on both sides."""
    ring = polygons.select("grp", "poly", "ring")
    e = polygon_edges(ring).join(ring.select("grp", "poly"), "poly").where("x1 <> x2 OR y1 <> y2")
    turn = e.groupBy("poly").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("turn"))
    e = e.join(turn.where("turn <> 0"), "poly")
    flip = lambda a, b: F.when(F.col("turn") > 0, F.col(a)).otherwise(F.col(b))
    e = stored(e.select("grp", "poly", flip("x1", "x2").alias("x1"), flip("y1", "y2").alias("y1"), flip("x2", "x1").alias("x2"), flip("y2", "y1").alias("y2")))
    edge = ["grp", "poly", "x1", "y1", "x2", "y2"]

    cells = lambda a, b: F.explode(F.sequence(F.floor(F.least(a, b) / cell), F.floor(F.greatest(a, b) / cell)))
    c = e.withColumn("_cx", cells("x1", "x2")).withColumn("_cy", cells("y1", "y2"))
    o = c.select("grp", "_cx", "_cy", F.col("poly").alias("other"), *[F.col(k).alias(f"o{k}") for k in ("x1", "y1", "x2", "y2")])
    own, theirs = [F.col(k) for k in edge[2:]], [F.col(f"o{k}") for k in edge[2:]]
    met = c.join(o, ["grp", "_cx", "_cy"]).where((F.col("poly") != F.col("other")) & segments_meet(own, theirs))
    dx, dy, ox, oy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("ox2") - F.col("ox1"), F.col("oy2") - F.col("oy1")
    det = dx * oy - dy * ox
    at = lambda x, y: ((x - F.col("x1")) * dx + (y - F.col("y1")) * dy) / (dx * dx + dy * dy)
    cut = F.when(det != 0, F.array(((F.col("ox1") - F.col("x1")) * oy - (F.col("oy1") - F.col("y1")) * ox) / det)).otherwise(F.array(at(F.col("ox1"), F.col("oy1")), at(F.col("ox2"), F.col("oy2"))))
    cuts = met.select(*edge, F.explode(cut).alias("t")).where("t > 0 AND t < 1")
    cuts = cuts.unionByName(e.withColumn("t", F.explode(F.array(F.lit(0.0), F.lit(1.0))))).distinct()
    p = cuts.withColumn("u", F.lead("t").over(Window.partitionBy(*edge).orderBy("t"))).where("u IS NOT NULL")
    on = lambda t: ((F.col("x1") + F.col(t) * (F.col("x2") - F.col("x1"))), (F.col("y1") + F.col(t) * (F.col("y2") - F.col("y1"))))
    (ax, ay), (bx, by) = on("t"), on("u")
    p = p.select("grp", "poly", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    a, b = (F.struct(F.round(f"{n}x", 6).alias("x"), F.round(f"{n}y", 6).alias("y")) for n in "ab")
    p = stored(p.withColumn("a", a).withColumn("b", b).where("a <> b").withColumn("k", F.struct(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).withColumn("up", F.col("a") < F.col("b")).drop("a", "b"))

    # Inside, even-odd, of polygons of the group other than those that have the very piece.
    band = lambda y: F.floor(y / cell)
    mid = p.select("grp", "k").distinct().withColumn("x", (F.col("k.a.x") + F.col("k.b.x")) / 2).withColumn("y", (F.col("k.a.y") + F.col("k.b.y")) / 2).withColumn("_b", band(F.col("y")))
    w = e.where("y1 <> y2").withColumn("_b", F.explode(F.sequence(band(F.least("y1", "y2")), band(F.greatest("y1", "y2")))))
    crosses = ((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < F.col("x1") + (F.col("y") - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    inside = mid.join(w, ["grp", "_b"]).where(crosses).groupBy("grp", "k", "poly").agg(F.count(F.lit(1)).alias("n")).where("n % 2 = 1")
    inside = inside.join(p.select("grp", "k", "poly"), ["grp", "k", "poly"], "left_anti").select("grp", "k").distinct()
    out = p.join(inside, ["grp", "k"], "left_anti").groupBy("grp", "k").agg(F.min(F.struct("poly", "ax", "ay", "bx", "by")).alias("m"), F.countDistinct("up").alias("ways")).where("ways = 1")
    return out.select("grp", "m.poly", F.col("m.ax").alias("x1"), F.col("m.ay").alias("y1"), F.col("m.bx").alias("x2"), F.col("m.by").alias("y2"))


def union_areas(polygons: DataFrame, cell: float) -> DataFrame:
    """grp, area, outline (metres) of the union of each group's polygons (grp, poly, ring); groups without area give no row."""
    o = union_outline(polygons, cell)
    size = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return o.groupBy("grp").agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("area"), F.sum(size).alias("outline"))
