"""Geometry as column expressions: everything stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: mean Earth radii of the two conventions, metres per degree of latitude.
EARTH_INGEST, EARTH_NETWORK, DEGREE_M = 6_371_008.8, 6_371_000.0, 111_320.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = EARTH_NETWORK) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), F.lit(2))
    return 2 * radius * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


def local_meters(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular distance, good for a city."""
    dx = (lng2 - lng1) * DEGREE_M * F.cos(F.radians(lat1))
    dy = (lat2 - lat1) * DEGREE_M
    return F.sqrt(dx * dx + dy * dy)


def pixel_x(lng: Column, zoom: int) -> Column:
    return (lng + 180) / 360 * (256 << zoom)


def pixel_y(lat: Column, zoom: int) -> Column:
    s = F.sin(F.radians(lat))
    return (F.lit(0.5) - F.log((1 + s) / (1 - s)) / (4 * math.pi)) * (256 << zoom)


def tile(pixel: Column) -> Column:
    return F.floor(pixel / 256).cast("int")


def bearing(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(x2 - x1, y2 - y1)), F.lit(360.0))


def line_angle(a: Column, b: Column) -> Column:
    """The angle between two undirected lines, 0 to 90."""
    d = F.pmod(a - b, F.lit(180.0))
    return F.least(d, 180.0 - d)


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = along(px, py, ax, ay, bx, by)
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    dx, dy = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(dx * dx + dy * dy)


def along(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Where the foot of the perpendicular falls: 0 at a, 1 at b (0 for a point-like segment)."""
    size = (bx - ax) * (bx - ax) + (by - ay) * (by - ay)
    return F.when(size > 0, ((px - ax) * (bx - ax) + (py - ay) * (by - ay)) / size).otherwise(0.0)


def half_up(x: Column) -> Column:
    """Rounds halves towards plus infinity."""
    return F.floor(x + 0.5)


def fraction_byte(share: Column) -> Column:
    """A share of 0 to 1 as 0 to 254."""
    return F.least(F.lit(254), F.greatest(F.lit(0), half_up(share * 254))).cast("int")


def grade_speed(grade: Column) -> Column:
    """Speed on a grade relative to the flat: fastest on a descent of 5 %."""
    return F.exp(-3.5 * (F.abs(grade + 0.05) - 0.05))


def climb_speed(ascent: Column, descent: Column) -> Column:
    """Speed factor over a stretch that rises and falls by these grades."""
    g = ascent + descent
    return F.when(g == 0, 1.0).otherwise(g / (ascent / grade_speed(g) + descent / grade_speed(-g)))


def crown_diameter(dbh_inches: Column, a: float, b: float, correction: float) -> Column:
    return F.exp(F.lit(a) + b * F.log(F.log(dbh_inches * 2.54 + 1)) + correction)


def ring_area(ring: Column) -> Column:
    """Signed area of a closed or open ring of (x, y) structs, by the shoelace rule."""
    n = F.size(ring)
    terms = F.transform(ring, lambda p, i: p["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * p["y"])
    return F.aggregate(terms, F.lit(0.0), lambda s, v: s + v) / 2


def solar_elevation(lat: Column, declination: Column, hour_angle: Column) -> Column:
    la, d, h = F.radians(lat), F.radians(declination), F.radians(hour_angle)
    return F.degrees(F.asin(F.sin(la) * F.sin(d) + F.cos(la) * F.cos(d) * F.cos(h)))


def season_band(declination: Column, bands: int = 6, tilt: float = 23.44) -> Column:
    """Which of equal bands of declination, from winter to summer."""
    return F.greatest(F.lit(0), F.least(F.lit(bands - 1), F.floor((declination + tilt) / (2 * tilt) * bands))).cast("int")


def smoothstep(x: Column) -> Column:
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))
    return t * t * (3 - 2 * t)


def half_way_decay(meters: Column, floor: float = 0.25, scale: float = 1500.0) -> Column:
    """1 near by, falling to a floor: a distance's weight in ranking."""
    return floor + (1 - floor) * F.exp(-meters / scale)
