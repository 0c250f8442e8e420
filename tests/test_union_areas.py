"""Unions whose areas are known by hand, and random ones by counting points."""

import random

import pytest

from strider.operators import areas

RINGS = "grp int, poly int, ring array<struct<x: double, y: double>>"


def box(x, y, w, h, back=False):
    ring = [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]
    return [{"x": float(a), "y": float(b)} for a, b in (ring[::-1] if back else ring)]


def test_known_unions(spark):
    groups = {
        1: ([box(0, 0, 10, 10), box(10, 0, 10, 10)], 200, 60),  # they touch along an edge
        2: ([box(0, 0, 10, 10), box(0, 0, 10, 10, True)], 100, 40),  # the same twice
        3: ([box(0, 0, 10, 10), box(2, 2, 3, 3)], 100, 40),  # one within the other
        4: ([box(0, 0, 10, 10), box(5, 5, 10, 10, True)], 175, 60),
        5: ([box(0, 0, 10, 10), box(40, 0, 10, 10)], 200, 80),  # apart
        6: ([box(0, 0, 30, 10), box(0, 20, 30, 10), box(0, 0, 10, 30), box(20, 0, 10, 30)], 800, 160),  # a court: its outline counts too
        7: ([box(0, 0, 10, 10), box(10, 4, 5, 3)], 115, 50),  # part of an edge
        8: ([box(0, 0, 10, 10), box(10, 10, 10, 10)], 200, 80),  # a corner
        9: ([box(3, 3, 0, 5)], None, None),  # no area
    }
    rows = [(g, g * 10 + i, ring) for g, (rings, _, _) in groups.items() for i, ring in enumerate(rings)]
    got = {r.grp: (round(r.area, 6), round(r.outline, 6)) for r in areas.union_areas(spark.createDataFrame(rows, RINGS), 7.0).collect()}
    assert got == {g: (area, outline) for g, (_, area, outline) in groups.items() if area}
    assert areas.union_areas(spark.createDataFrame([], RINGS), 7.0).collect() == []


@pytest.mark.parametrize("cell", [3.0, 50.0])
def test_random_unions(spark, cell):
    """Whole boxes on a lattice: every unit square is in or out."""
    rnd = random.Random(3)
    rows = [(g, g * 100 + i, box(rnd.randrange(20), rnd.randrange(20), rnd.randrange(1, 8), rnd.randrange(1, 8), rnd.random() < 0.5)) for g in range(4) for i in range(14)]
    got = {r.grp: round(r.area, 6) for r in areas.union_areas(spark.createDataFrame(rows, RINGS), cell).collect()}
    for g in range(4):
        squares = {(x, y) for grp, _, ring in rows if grp == g for x in range(int(min(p["x"] for p in ring)), int(max(p["x"] for p in ring))) for y in range(int(min(p["y"] for p in ring)), int(max(p["y"] for p in ring)))}
        assert got[g] == len(squares)
