"""Heights above ground from returns, and shade of what stands along lines, per place of the sun."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.operators import lines
from strider.operators.spatial import point_in_polygon
from strider.operators.stored import stored

#: Rings that ground is carried at most; metres between probes of a line, and of a shade cell.
RINGS, PROBE, SHADE_CELL = 64, 5.0, 5.0
#: Bands of declination between its extremes (degrees), the elevation from which there is a sun, and the least
#: share of its cover that a shed keeps when the sun comes in from the side.
BANDS, MOST_DECLINATION, HORIZON, OBLIQUE = 6, 23.44, 0.5, 0.15
#: Places of the sun that one call takes: they go to every task.
MOST_SUNS = 10_000


def ground_filled(cells: DataFrame, rings: int = RINGS) -> DataFrame:
    """x, y, ground of cells (x, y, ground or null): the cells that know theirs, and within their box those up to `rings` steps
    (along rows and columns) away, which take the nearest one's; of equals the one of the least y, then the least x.

    A round spreads from the cells of the round before only, so it is as large as their rim, and writes just that."""
    known = stored(cells.where("ground IS NOT NULL").select("x", "y", "ground", F.struct("y", "x").alias("of")))
    box = cells.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    if box["x0"] is None:
        return known.drop("of")
    around = F.explode(F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((-1, 0), (1, 0), (0, -1), (0, 1))]))
    inside = F.col("x").between(box["x0"], box["x1"]) & F.col("y").between(box["y0"], box["y1"])
    found = [known]
    for _ in range(rings):
        out = found[-1].select(around.alias("c"), "ground", "of").select("c.x", "c.y", "ground", "of").where(inside)
        out = out.groupBy("x", "y").agg(F.min(F.struct("of", "ground")).alias("m")).select("x", "y", "m.ground", "m.of")
        # Only the two rounds before can hold a neighbour that is known already.
        for before in found[-2:] if len(found) > 2 else found:
            out = out.join(before.select("x", "y"), ["x", "y"], "left_anti")
        out = stored(out)
        if out.isEmpty():
            break
        found.append(out)
    return reduce(DataFrame.unionByName, found).drop("of")


def heights(returns: DataFrame, cell: float, staged: DataFrame | None = None, rings: int = RINGS) -> DataFrame:
    """cx, cy, height, ground of the cells with a surface: the highest surface return less the ground.

    returns are rows (x, y, z, kind: 'surface', 'ground' or other). Ground is what `staged` (cx, cy, ground) says, else the mean of a
    cell's ground returns (each to a tenth of a metre), else that of the nearest cell that has one. Cells out of
    reach of any ground have a null height."""
    at = lambda c: F.floor(F.col(c) / cell).alias(f"c{c}")
    z = lambda kind: F.when(F.col("kind") == kind, F.col("z"))
    b = returns.groupBy(at("x"), at("y")).agg(F.max(z("surface")).alias("top"), (F.sum(F.round(z("ground") * 10)) / F.count(z("ground")) / 10).alias("mean"))
    b = stored(b)
    known = b.select("cx", "cy", F.col("mean").alias("ground"))
    if staged is not None:
        s = staged.select("cx", "cy", F.col("ground").alias("staged"))
        known = known.join(s, ["cx", "cy"], "full").select("cx", "cy", F.coalesce("staged", "ground").alias("ground"))
    g = ground_filled(known.select(F.col("cx").alias("x"), F.col("cy").alias("y"), "ground"), rings)
    g = g.select(F.col("x").alias("cx"), F.col("y").alias("cy"), "ground")
    return b.where("top IS NOT NULL").join(g, ["cx", "cy"], "left").select("cx", "cy", (F.col("top") - F.col("ground")).alias("height"), "ground")


def sun(latitude: Column, declination: Column, hour_angle: Column) -> tuple[Column, Column, Column]:
    """Elevation (degrees), and the unit vector east, north in which shadows fall, of a sun in degrees."""
    lat, dec, hour = (F.radians(c) for c in (latitude, declination, hour_angle))
    up = F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(hour)
    east, north = -F.cos(dec) * F.sin(hour), F.cos(lat) * F.sin(dec) - F.sin(lat) * F.cos(dec) * F.cos(hour)
    flat = F.hypot(east, north)
    return F.degrees(F.asin(up)), -east / flat, -north / flat


def line_shade(vertices: DataFrame, casters: DataFrame, suns: DataFrame, longest: float, cell: float = SHADE_CELL, tile: float = 60.0) -> DataFrame:
    """line, bin, shade (1 to 255): which share of the probes along a line (line, i, x, y) stands in a shadow. No row: none does.

    casters are rows (poly, ring of (x, y), height); suns rows (bin, east, north, reach), a small table: where shadows fall
    and how long they are for a metre of height, at most `longest` metres in all. A probe counts as shaded if the middle
    of its cell is. A shadow is what a footprint covers as it slides away from the sun: the footprint and, for
    each of its edges, a parallelogram; these meet cells by tiles, so no caster meets all lines."""
    p = lines.pieces(vertices)
    n = F.greatest(F.lit(1), F.ceil(F.col("meters") / PROBE)).cast("int")
    p = p.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("t", F.col("k") / F.col("n"))
    probes = p.select("line", (F.col("ax") + F.col("t") * (F.col("bx") - F.col("ax"))).alias("x"), (F.col("ay") + F.col("t") * (F.col("by") - F.col("ay"))).alias("y"))
    first = vertices.groupBy("line").agg(F.min_by(F.struct("x", "y"), "i").alias("m")).select("line", "m.x", "m.y")
    if suns.count() > MOST_SUNS:
        raise ValueError(f"more than {MOST_SUNS} places of the sun")
    suns = F.broadcast(suns.where("reach > 0"))
    probes = probes.unionByName(first).groupBy("line", F.floor(F.col("x") / cell).alias("cx"), F.floor(F.col("y") / cell).alias("cy")).agg(F.count(F.lit(1)).alias("k"))
    probes = stored(probes)
    mid = lambda c: ((F.col(c) + 0.5) * cell)
    cells = stored(probes.select("cx", "cy").distinct().select(F.struct("cx", "cy").alias("id"), mid("cx").alias("x"), mid("cy").alias("y")))

    up = casters.where("height > 0 AND size(ring) > 2")
    # Casters go to the tiles that their longest shadow may reach, and are multiplied by the suns only once they met a cell there.
    farthest = suns.agg(F.max("reach")).first()[0]
    wide, far = max(tile, longest), F.least(F.col("height") * F.lit(farthest), F.lit(longest)) + 1e-3
    edge = lambda f, c: f(F.transform("ring", lambda p: p[c]))
    e = up.select("ring", "height", *[edge(f, c).alias(f"{n}{c}") for n, f in (("lo", F.array_min), ("hi", F.array_max)) for c in "xy"])
    for c in "xy":
        e = e.withColumn(f"t{c}", F.explode(F.sequence(F.floor((F.col(f"lo{c}") - far) / wide), F.floor((F.col(f"hi{c}") + far) / wide))))
    c = cells.withColumn("tx", F.floor(F.col("x") / wide)).withColumn("ty", F.floor(F.col("y") / wide))
    met = c.join(e.hint("merge"), ["tx", "ty"])
    for k in "xy":
        met = met.where((F.col(k) >= F.col(f"lo{k}") - far) & (F.col(k) <= F.col(f"hi{k}") + far))
    away = F.least(F.col("height") * F.col("reach"), F.lit(longest))
    met = met.join(suns, F.lit(True), "cross").withColumn("dx", away * F.col("east")).withColumn("dy", away * F.col("north"))
    for k in "xy":
        met = met.where((F.col(k) >= F.col(f"lo{k}") + F.least(F.lit(0.0), f"d{k}") - 1e-3) & (F.col(k) <= F.col(f"hi{k}") + F.greatest(F.lit(0.0), f"d{k}") + 1e-3))
    n = F.size("ring")
    met = met.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("a", F.get("ring", F.col("i"))).withColumn("b", F.get("ring", (F.col("i") + 1) % n))
    met = met.select("id", "bin", "x", "y", "dx", "dy", *[F.col(f"{p}.{k}").alias(f"{k}{j}") for p, j in (("a", 1), ("b", 2)) for k in "xy"])
    met = met.withColumn("det", (F.col("x2") - F.col("x1")) * F.col("dy") - (F.col("y2") - F.col("y1")) * F.col("dx")).where("det <> 0")
    u = ((F.col("x") - F.col("x1")) * F.col("dy") - (F.col("y") - F.col("y1")) * F.col("dx")) / F.col("det")
    t = ((F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))) / F.col("det")
    swept = met.where(u.between(0, 1) & t.between(0, 1)).select("id", "bin")
    under = point_in_polygon(cells, up, tile).select("id").distinct().join(suns.select("bin"), F.lit(True), "cross")
    dark = swept.unionByName(under).distinct().select("id.cx", "id.cy", "bin")
    total = probes.groupBy("line").agg(F.sum("k").alias("n"))
    shaded = probes.join(dark, ["cx", "cy"]).groupBy("line", "bin").agg(F.sum("k").alias("shaded"))
    share = F.floor(F.col("shaded") / F.col("n") * 255 + 0.5).cast("int")
    return shaded.join(total, "line").select("line", "bin", share.alias("shade")).where("shade > 0")


def season_band(declination: Column) -> Column:
    """0 for the lowest suns to BANDS - 1 for the highest."""
    share = (declination + MOST_DECLINATION) / (2 * MOST_DECLINATION)
    return F.least(F.lit(BANDS - 1), F.greatest(F.lit(0), F.floor(share * BANDS))).cast("int")


def blends(instants: DataFrame, bins: DataFrame) -> DataFrame:
    """id, nearest, second, w1, w2 for the instants (id, elevation, declination, hour) with a sun: the two bins (bin, season, hour)
    of the instant's season, or of all if it has none, whose hours are nearest (of equals the smaller bin), weighted by
    closeness to the other. A lone bin, or one at the very hour of both, has all the weight.

    The bins are a small table: they travel as one list, so no instant is multiplied."""
    if bins.count() > MOST_SUNS:
        raise ValueError(f"more than {MOST_SUNS} bins")
    listed = F.broadcast(bins.agg(F.collect_list(F.struct("season", "hour", "bin")).alias("bins")))
    i = instants.where(F.col("elevation") > HORIZON).withColumn("season", season_band(F.col("declination")))
    i = i.join(listed, F.lit(True), "cross").where(F.size("bins") > 0)
    own = F.filter("bins", lambda b: b["season"] == F.col("season"))
    i = i.withColumn("bins", F.when(F.size(own) > 0, own).otherwise(F.col("bins")))
    near = F.array_sort(F.transform("bins", lambda b: F.struct(F.abs(b["hour"] - F.col("hour")).alias("off"), b["bin"].alias("bin"))))
    i = i.select("id", F.get(near, F.lit(0)).alias("p"), F.get(near, F.lit(1)).alias("q"))
    total = F.col("p.off") + F.col("q.off")
    alone = F.col("q").isNull() | (total == 0)
    second = F.when(alone, F.col("p.bin")).otherwise(F.col("q.bin"))
    w1 = F.when(alone, 1.0).otherwise(F.col("q.off") / total)
    return i.select("id", F.col("p.bin").alias("nearest"), second.alias("second"), w1.alias("w1"), F.when(alone, 0.0).otherwise(F.col("p.off") / total).alias("w2"))


def blended(asked: DataFrame, mixes: DataFrame, shades: DataFrame) -> DataFrame:
    """id, line, shade (0 to 255) of what is asked (id, line): the line's shade in the two bins of the id's mix; a bin without
    a row is no shade, an id without a mix (no sun) gives no row."""
    each = F.explode(F.array(F.struct(F.col("nearest").alias("bin"), F.col("w1").alias("w")), F.struct(F.col("second").alias("bin"), F.col("w2").alias("w"))))
    a = asked.select("id", "line").join(mixes.select("id", each.alias("m")), "id").select("id", "line", "m.bin", "m.w")
    return a.join(shades, ["line", "bin"], "left").groupBy("id", "line").agg(F.sum(F.col("w") * F.coalesce("shade", F.lit(0))).alias("shade"))


def shed_shade(covered: Column, across: Column, sun_azimuth: Column, bearing: Column, depth: Column) -> Column:
    """The share of a line that a shed shades (angles in radians): its cover, less what the sun lights from the side, where the roof
    seems moved `across` metres for a sun square to the line, of `depth` metres; never under OBLIQUE of the cover."""
    side = across * F.abs(F.sin(sun_azimuth - bearing)) / depth
    return F.when(covered > 0, covered * F.greatest(F.lit(OBLIQUE), 1 - side)).otherwise(0.0)
