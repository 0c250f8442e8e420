"""Ground carried to cells without, shadows and blends against plain versions."""

import math
import random
from collections import deque

import pytest

from strider.operators import shade

CELL = "x long, y long, ground double"


def carried(cells, rings):
    """Breadth first, seeds row by row."""
    xs, ys = [c[0] for c in cells], [c[1] for c in cells]
    out = {(x, y): g for x, y, g in cells if g is not None}
    queue = deque(((x, y), 0) for x, y in sorted(out, key=lambda c: (c[1], c[0])))
    while queue:
        (x, y), ring = queue.popleft()
        for c in ((x - 1, y), (x + 1, y), (x, y - 1), (x, y + 1)) if ring < rings else ():
            if c not in out and min(xs) <= c[0] <= max(xs) and min(ys) <= c[1] <= max(ys):
                out[c] = out[x, y]
                queue.append((c, ring + 1))
    return sorted((x, y, g) for (x, y), g in out.items())


@pytest.mark.parametrize("rings", [1, 4, 64])
def test_nearest_ground(spark, rings):
    rnd = random.Random(5)
    cells = [(x, y, rnd.random() if rnd.random() < 0.12 else None) for x in range(14) for y in range(11) if rnd.random() < 0.8]
    got = shade.ground_filled(spark.createDataFrame(cells, CELL), rings).collect()
    assert sorted(map(tuple, got)) == carried(cells, rings)


def test_no_ground(spark):
    assert shade.ground_filled(spark.createDataFrame([], CELL)).collect() == []
    assert shade.ground_filled(spark.createDataFrame([(1, 1, None)], CELL)).collect() == []
    rows = spark.createDataFrame([(1.0, 1.0, 9.0, "surface"), (99.0, 1.0, 4.0, "other")], "x double, y double, z double, kind string")
    assert [tuple(r) for r in shade.heights(rows, 2.0).collect()] == [(0, 0, None, None)]


def inside(ring, x, y):
    hit = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (ay > y) != (by > y) and x < ax + (y - ay) * (bx - ax) / (by - ay):
            hit = not hit
    return hit


def plain_shade(lines, casters, suns, longest):
    out = {}
    for line, v in lines.items():
        probes = [v[0]]
        for (ax, ay), (bx, by) in zip(v, v[1:]):
            n = max(1, math.ceil(math.hypot(bx - ax, by - ay) / 5))
            probes += [(ax + k / n * (bx - ax), ay + k / n * (by - ay)) for k in range(1, n + 1)]
        for bin_, east, north, reach in suns:
            dark = 0
            for x, y in probes:
                x, y = (math.floor(x / 5) + 0.5) * 5, (math.floor(y / 5) + 0.5) * 5
                # Looking back at the sun: any of many steps that is over a footprint.
                dark += any(inside(ring, x - t * east, y - t * north) for ring, h in casters if h > 0 for t in [min(h * reach, longest) * s / 400 for s in range(401)])
            share = math.floor(dark / len(probes) * 255 + 0.5)
            if share:
                out[line, bin_] = share
    return out


def test_shadows_of_bent_footprints(spark):
    ell = [(0, 0), (40, 0), (40, 12), (12, 12), (12, 40), (0, 40)]
    casters = [([(x + 7.3, y + 11.1) for x, y in ell], 20.0), ([(x + 90.7, y + 3.9) for x, y in ell[::-1]], 45.0), ([(x + 50.0, y + 60.0) for x, y in ell], 0.0)]
    lines = {1: [(-60.0, 30.0), (40.0, 33.0), (160.0, 90.0)], 2: [(20.0, -40.0), (21.0, 120.0)], 3: [(900.0, 900.0), (950.0, 900.0)], 4: [(8.0, 12.0)]}
    suns = [(1, 0.6, 0.8, 1.7), (2, -0.8, 0.6, 4.0), (3, 1.0, 0.0, 0.9)]
    v = spark.createDataFrame([(n, i, x, y) for n, vs in lines.items() for i, (x, y) in enumerate(vs)], "line long, i int, x double, y double")
    c = spark.createDataFrame([(i, [{"x": float(x), "y": float(y)} for x, y in ring], h) for i, (ring, h) in enumerate(casters)], "poly int, ring array<struct<x: double, y: double>>, height double")
    s = spark.createDataFrame(suns, "bin int, east double, north double, reach double")
    got = {(r.line, r.bin): r.shade for r in shade.line_shade(v, c, s, 90.0).collect()}
    want = plain_shade(lines, casters, suns, 90.0)
    assert got == want and len(want) > 5
    assert shade.line_shade(v, c.where("height > 99"), s, 90.0).collect() == []
