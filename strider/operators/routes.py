"""Snapping points to a network, following parents to a path, and what a walked route looks like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.functions import geo
from strider.operators import spatial
from strider.operators.graph import components, settled


def snap_candidates(points: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """id, component, seg, dist: of each component the nearest segment (seg, ax, ay, bx, by,
    component) in reach of a point (id, x, y); ties by segment. Cells keep the join local."""
    p = spatial._cells(points.select("id", "x", "y"), "x", "y", reach)
    # Of equal segments of a component only the least can be the nearest.
    s = segments.groupBy("component", "ax", "ay", "bx", "by").agg(F.min("seg").alias("seg"))
    s = spatial._strip_cells(s, reach, reach).hint("merge")
    dist = geo.segment_distance(*[F.col(k) for k in ("x", "y", "ax", "ay", "bx", "by")])
    hit = p.join(s, ["_cx", "_cy"]).withColumn("dist", dist).where(F.col("dist") <= reach)
    return hit.groupBy("id", "component").agg(F.min(F.struct("dist", "seg")).alias("m")).select("id", "component", F.col("m.seg").alias("seg"), F.col("m.dist").alias("dist"))


def snap_pairs(trips: DataFrame, candidates: DataFrame) -> DataFrame:
    """trip, start_seg, dest_seg, total: for trips (trip, start, dest) of point ids the pair on one
    component with the least sum of distances (ties by component); none where nothing joins them."""
    a = candidates.select(F.col("id").alias("start"), "component", F.col("seg").alias("start_seg"), F.col("dist").alias("d1"))
    b = candidates.select(F.col("id").alias("dest"), "component", F.col("seg").alias("dest_seg"), F.col("dist").alias("d2"))
    both = trips.join(a, "start").join(b, ["dest", "component"]).withColumn("total", F.col("d1") + F.col("d2"))
    best = both.groupBy("trip").agg(F.min(F.struct("total", "component", "start_seg", "dest_seg")).alias("m"))
    return best.select("trip", F.col("m.start_seg").alias("start_seg"), F.col("m.dest_seg").alias("dest_seg"), F.col("m.total").alias("total"))


def paths(reached: DataFrame, goals: DataFrame) -> DataFrame:
    """goal, back, node: the nodes from each goal (node) back to a seed, over the parents of
    reached (node, parent). One join a round; a round takes every goal one node further."""
    parents = settled(reached.select("node", "parent"))
    out = front = settled(goals.select(F.col("node").alias("goal"), "node").join(parents.select("node"), "node", "left_semi").select("goal", "node", F.lit(0).alias("back")))
    while True:
        step = front.join(parents, "node").where("parent IS NOT NULL")
        front = settled(step.select("goal", F.col("parent").alias("node"), (F.col("back") + 1).alias("back")))
        if front.isEmpty():
            return out.select("goal", "back", "node")
        out = settled(out.unionByName(front))


def crossing_reversals(steps: DataFrame, gap: float, cosine: float) -> DataFrame:
    """route, seq, between: crossings of a route that turn back a crossing shortly before them.

    steps (route, seq, kind, x, y, length): x, y is the unit direction. A crossing reverses the last
    one if at most `gap` was walked since, and their directions' cosine is at most `cosine`."""
    along = F.sum("length").over(Window.partitionBy("route").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    crossings = steps.withColumn("ends", along).where("kind = 'crossing'")
    w = Window.partitionBy("route").orderBy("seq")
    between = F.col("ends") - F.col("length") - F.lag("ends").over(w)
    turn = F.col("x") * F.lag("x").over(w) + F.col("y") * F.lag("y").over(w)
    return crossings.select("route", "seq", between.alias("between"), turn.alias("turn")).where((F.col("between") <= gap) & (F.col("turn") <= cosine)).select("route", "seq", "between")


def detour_ratio(walked: Column, straight: Column) -> Column:
    """How much longer than the straight line a route is; null where the ends coincide."""
    return F.when(straight > 0, walked / straight)


def merged_nodes(points: DataFrame, unit: float, reach: float) -> DataFrame:
    """id, node: points (id, x, y) on one lattice cell of `unit` are one node; nodes within reach of
    each other, or linked by such, are one too. node is the smallest id."""
    cell = points.select("id", F.floor(F.col("x") / unit + 0.5).alias("qx"), F.floor(F.col("y") / unit + 0.5).alias("qy"))
    exact = settled(cell.groupBy("qx", "qy").agg(F.min("id").alias("first")))
    at = exact.select(F.col("first").alias("lid"), (F.col("qx") * unit).alias("x"), (F.col("qy") * unit).alias("y"))
    close = spatial.within(at, at.withColumnRenamed("lid", "rid"), reach).where("lid < rid").select(F.col("lid").alias("a"), F.col("rid").alias("b"))
    joined = components(close).select(F.col("node").alias("first"), "component")
    named = cell.join(exact, ["qx", "qy"]).join(joined, "first", "left")
    return named.select("id", F.coalesce("component", "first").alias("node"))


def turn_bearings(vertices: DataFrame) -> DataFrame:
    """line, seq, bearing: at each vertex (line, seq, x, y) the direction from the one before to the
    one after (at an end, of its only side), clockwise from north in radians."""
    w = Window.partitionBy("line").orderBy("seq")
    dx = F.coalesce(F.lead("x").over(w), F.col("x")) - F.coalesce(F.lag("x").over(w), F.col("x"))
    dy = F.coalesce(F.lead("y").over(w), F.col("y")) - F.coalesce(F.lag("y").over(w), F.col("y"))
    return vertices.select("line", "seq", dx.alias("dx"), dy.alias("dy")).select("line", "seq", F.when((F.col("dx") != 0) | (F.col("dy") != 0), F.atan2("dx", "dy")).alias("bearing"))


def side_label(bearing: Column) -> Column:
    """N, E, S or W: the quarter into which the normal on a line's left points."""
    quarter = F.floor(F.pmod(bearing - F.pi() / 2 + F.pi() / 4, 2 * F.pi()) / (F.pi() / 2)).cast("int")
    return F.get(F.array(*[F.lit(x) for x in "NESW"]), F.least(quarter, F.lit(3)))


def fans(ends: DataFrame) -> DataFrame:
    """node, edge, next_edge: around each node its edges (node, edge, bearing) in order of bearing,
    each with the one that follows clockwise (the first after the last)."""
    w = Window.partitionBy("node").orderBy("bearing", "edge")
    first = F.first("edge").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ends.select("node", "edge", F.coalesce(F.lead("edge").over(w), first).alias("next_edge"))
