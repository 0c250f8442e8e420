"""What an edge costs: seconds to walk it and factors that make it dearer or cheaper.

Edges carry bytes (0 to 254) per factor, weights are a row per lens, so every lens prices every
edge in one broadcast join and one projection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strider.functions import geo

#: Fixed: walking pace, wait at a crossing, boarding, waits beyond which a ride is no choice,
#: the grade that prices a hill once, what a tunnel shelters, the price of an avoided shed, floor.
PACE, CROSSING_S, BOARDING_S, FERRY_WAIT_S, RAIL_WAIT_S = 1.3, 3.0, 60.0, 5400.0, 1800.0
HILL_GRADE, TUNNEL_SHELTER, SHED_PENALTY, FLOOR = 0.12, 254 / 255, 20.0, 0.05
MAX_GRADE = 0.35
CHEAPER = ["cover", "landmark", "art", "commercial", "historic", "bridge"]
DEARER = ["highway", "industrial"]


def hill_price(ascent: Column, descent: Column) -> Column:
    share = (ascent + descent) / 255 * MAX_GRADE / HILL_GRADE
    return share * share


def multiplier(shed: Column | None = None) -> Column:
    """The product of all factors of an edge (columns by name, weights as w_name)."""
    terms = [1 - F.col(f"w_{k}") * F.col(k) / 255 for k in CHEAPER] + [1 + F.col(f"w_{k}") * F.col(k) / 255 for k in DEARER]
    terms.append(1 + F.col("w_hill") * hill_price(F.col("ascent"), F.col("descent")))
    scenic = reduce(lambda a, b: a * b, terms)
    return scenic if shed is None else scenic * (1 - shed) + shed + SHED_PENALTY * shed


def walk_seconds(mid_roadway: Column | None = None) -> Column:
    """Seconds over length_m with ascent and descent bytes; a crossing entered from a pavement waits."""
    grade = lambda c: F.col(c) / 255 * MAX_GRADE
    base = F.col("length_m") / (PACE * geo.climb_speed(grade("ascent"), grade("descent")))
    if mid_roadway is None:
        return base
    return base + F.when((F.col("kind") == "crossing") & ~mid_roadway, CROSSING_S).otherwise(0.0)


def capped_wait(wait: Column, cap: float, extra: float = 0.0) -> Column:
    """The wait, or infinity where there is none or it is beyond the cap."""
    return F.when(wait.isNull() | (wait > cap), F.lit(float("inf"))).otherwise(wait + extra)


def priced(edges: DataFrame, lenses: DataFrame) -> DataFrame:
    """edge, lens, raw_s, effective_s: lenses (lens, w_...) is a short table of weights."""
    rows = edges.join(F.broadcast(lenses), F.lit(True), "cross")
    raw = walk_seconds()
    return rows.select("edge", "lens", raw.alias("raw_s"), (raw * multiplier()).alias("effective_s"))


def factor_maxima(edges: DataFrame) -> DataFrame:
    return edges.agg(*[F.max(k).alias(f"max_{k}") for k in [*CHEAPER, *DEARER]])


def lowest_multiplier() -> Column:
    """A bound under every edge's multiplier, from factor_maxima joined to the weights."""
    return reduce(lambda a, b: a * b, [1 - F.greatest(F.lit(0.0), F.col(f"w_{k}")) * F.col(f"max_{k}") / 255 for k in CHEAPER])


def familiarity(weight: Column) -> Column:
    return 1 - F.exp(-weight / 2)


def route_shares(steps: DataFrame, factors: list[str]) -> DataFrame:
    """route and the time-weighted mean of each factor over its steps (route, seconds, bytes)."""
    total = F.sum("seconds")
    return steps.groupBy("route").agg(total.alias("seconds"), *[(F.sum(F.col("seconds") * F.col(k)) / total / 255).alias(k) for k in factors])


def shade_attribute(tunnel: Column, attribute: Column, intensity: Column, shed: Column) -> Column:
    """How sunny (negative: how shaded) an edge is; a tunnel is all shade, a deck as far as it shades."""
    return F.when(tunnel, -intensity).otherwise(attribute * (1 - shed) - shed * intensity)


def shelter_attribute(tunnel: Column, canopy: Column, rain_tau: float, shed: Column) -> Column:
    """What keeps rain off an edge: deck and crown as independent covers; a tunnel the byte's ceiling."""
    return F.when(tunnel, F.lit(TUNNEL_SHELTER)).otherwise(shed + rain_tau * canopy / 255 * (1 - shed))


def ride_multiplier(transit: Column, shelter: Column) -> Column:
    """The price of a second on rails, never free."""
    return (1 + transit) * F.greatest(F.lit(FLOOR), 1 - shelter)


def crossing_discount(ferry: Column, shelter: Column) -> Column:
    """The price of a second on the water, never free."""
    return F.greatest(F.lit(FLOOR), 1 - ferry) * F.greatest(F.lit(FLOOR), 1 - shelter)


def kind_seconds(wait: Column, mid_roadway: Column) -> Column:
    """Seconds over an edge by its kind (columns kind, duration_s, length_m, ascent, descent): a
    ferry waits and crosses, boarding waits, rides and accesses take their duration, the rest is
    walked. Infinite where nothing leaves in time."""
    return (
        F.when(F.col("kind") == "ferry", capped_wait(wait, FERRY_WAIT_S) + F.col("duration_s"))
        .when(F.col("kind") == "board", capped_wait(wait, RAIL_WAIT_S, BOARDING_S))
        .when(F.col("kind").isin("ride", "access"), F.col("duration_s").cast("double"))
        .otherwise(walk_seconds(mid_roadway))
    )
