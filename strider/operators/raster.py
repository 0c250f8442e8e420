"""Rasters as (x, y, value) rows and tiles as integer keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def tile_plan(points: DataFrame, zoom: int) -> DataFrame:
    """z, x, y of all tiles of the box around points (tx, ty: their tiles at `zoom`), and of their parents up to zoom 0."""
    box = points.agg(*[f(c).cast("long").alias(f"{n}{c}") for c in ("tx", "ty") for n, f in (("a", F.min), ("b", F.max))]).where("atx IS NOT NULL")
    base = box.withColumn("x", F.explode(F.sequence("atx", "btx"))).withColumn("y", F.explode(F.sequence("aty", "bty"))).select("x", "y")
    up = base.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(zoom))))
    return up.select("z", F.expr("shiftright(x, %d - z)" % zoom).alias("x"), F.expr("shiftright(y, %d - z)" % zoom).alias("y")).distinct()


def pyramid(cells: DataFrame, levels: int) -> DataFrame:
    """z, x, y, value: the mean of each coarser cell's base cells (x, y, value), for `levels` levels."""
    up = cells.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return up.groupBy("z", F.expr("shiftright(x, z)").alias("x"), F.expr("shiftright(y, z)").alias("y")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("cells"))


def neighbours(cells: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """x, y, value and n0.. of the cells at each offset (null where none), in one shuffle."""
    sent = F.array(*[F.struct((F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.lit(i).alias("i"), F.col("value").alias("v")) for i, (dx, dy) in enumerate([(0, 0), *offsets])])
    rows = cells.select(F.explode(sent).alias("c")).select("c.*")
    got = rows.groupBy("x", "y").agg(*[F.max(F.when(F.col("i") == i, F.col("v"))).alias("value" if i == 0 else f"n{i - 1}") for i in range(len(offsets) + 1)], F.max(F.col("i") == 0).alias("_own"))
    return got.where("_own").drop("_own")


def hillshade(cells: DataFrame, cell_m: float, light: tuple[float, float, float] = (-0.5, 0.5, 0.7071)) -> DataFrame:
    """x, y, shade: 0.65 + 0.5 * the clamped light on central differences; 1 beside a gap."""
    n = neighbours(cells, [(-1, 0), (1, 0), (0, -1), (0, 1)])
    gx, gy = (F.col("n1") - F.col("n0")) / (2 * cell_m), (F.col("n3") - F.col("n2")) / (2 * cell_m)
    lit = (-gx * light[0] - gy * light[1] + light[2]) / F.sqrt(gx * gx + gy * gy + 1)
    return n.select("x", "y", F.when(gx.isNull() | gy.isNull(), 1.0).otherwise(0.65 + 0.5 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), lit))).alias("shade"))


def close_holes(cells: DataFrame, rings: int = 1, least: int = 3) -> DataFrame:
    """cells, with null values that have `least` known ones around them set to their mean, ring by ring."""
    around = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]
    for _ in range(rings):
        n = neighbours(cells, around)
        known = F.array_compact(F.array(*[F.col(f"n{i}") for i in range(8)]))
        mean = F.aggregate(known, F.lit(0.0), lambda s, v: s + v) / F.size(known)
        cells = n.select("x", "y", F.coalesce("value", F.when(F.size(known) >= least, mean)).alias("value"))
    return cells


def zonal(cells: DataFrame, zones: DataFrame, quantile: float = 0.9) -> DataFrame:
    """zone, cells, mean, top of the cells that each zone's cell list (zone, x, y) covers."""
    return zones.join(cells, ["x", "y"]).groupBy("zone").agg(F.count("value").alias("cells"), F.avg("value").alias("mean"), F.expr(f"percentile_disc({quantile}) WITHIN GROUP (ORDER BY value)").alias("top"))


def stroke_pixels(lines: DataFrame, step: float, pixel: float) -> DataFrame:
    """x, y, length: how much of lines (ax, ay, bx, by) lies in each pixel, by even samples."""
    size = F.sqrt(F.pow(F.col("bx") - F.col("ax"), F.lit(2)) + F.pow(F.col("by") - F.col("ay"), F.lit(2)))
    rows = lines.withColumn("_l", size).withColumn("_n", F.greatest(F.lit(1), F.ceil(F.col("_l") / step)).cast("int")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    t = (F.col("_i") + 0.5) / F.col("_n")
    at = lambda p, q: F.floor((F.col(p) + t * (F.col(q) - F.col(p))) / pixel)
    return rows.groupBy(at("ax", "bx").alias("x"), at("ay", "by").alias("y")).agg(F.sum(F.col("_l") / F.col("_n")).alias("length"))


def fill(polygons: DataFrame, cell: float) -> DataFrame:
    """poly, x, y: the cells whose centre lies inside a polygon (poly, ring), even-odd, by the
    crossings of each row of cells; no cell is tested by itself."""
    from strider.operators import spatial

    edges = spatial.polygon_edges(polygons).where("y1 <> y2").withColumn("y", F.explode(F.sequence(F.floor(F.least("y1", "y2") / cell), F.floor(F.greatest("y1", "y2") / cell))))
    centre = (F.col("y") + 0.5) * cell
    cross = F.col("x1") + (centre - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    met = edges.where((F.col("y1") > centre) != (F.col("y2") > centre)).select("poly", "y", cross.alias("cross"))
    # Along a row every other crossing opens a span, which the next one closes.
    w = Window.partitionBy("poly", "y").orderBy("cross")
    spans = met.select("poly", "y", "cross", F.lead("cross").over(w).alias("to"), F.row_number().over(w).alias("i")).where("i % 2 = 1 AND to IS NOT NULL")
    first, last = F.ceil(F.col("cross") / cell - 0.5), F.ceil(F.col("to") / cell - 0.5) - 1
    return spans.where(first <= last).select("poly", F.explode(F.sequence(first, last)).alias("x"), "y")


def blurred(cells: DataFrame, kernel: list[float]) -> DataFrame:
    """x, y, value: a separable blur; kernel holds the weights from the middle outwards. Cells that
    are missing or null don't count; a cell's weights are scaled to what is there."""
    reach = len(kernel) - 1
    for dx, dy in ((1, 0), (0, 1)):
        offsets = [(k * dx, k * dy) for k in range(-reach, reach + 1) if k]
        n = neighbours(cells, offsets)
        parts = [("value", kernel[0]), *[(f"n{i}", kernel[abs(a + b)]) for i, (a, b) in enumerate(offsets)]]
        total = sum((F.coalesce(F.col(c) * w, F.lit(0.0)) for c, w in parts), F.lit(0.0))
        weight = sum((F.when(F.col(c).isNotNull(), w).otherwise(0.0) for c, w in parts), F.lit(0.0))
        cells = n.select("x", "y", F.when(F.col("value").isNotNull(), total / weight).alias("value"))
    return cells
