"""Points of one name that are too near to each other."""

from __future__ import annotations

from strider.operators import thinning
from strider.plans.spatial_graph import _grid
from strider.sources.tables import table


def apart_by_name(spark, d):
    """Parts of one name, in order of y and x, that are over 150 m from those of the name that stay before them."""
    points = _grid(spark, d).join(table(spark, d, "part").selectExpr("p_partkey AS rid", "p_name"), "rid")
    return thinning.greedy_apart(points, "p_name", ["y", "x", "rid"], 150.0).select("rid", "p_name")


QUERIES = {"apart_by_name": apart_by_name}

# One point of every name a step: the first of those left, without those near it.
ORACLES = {
    "apart_by_name": """WITH RECURSIVE p AS (SELECT p_name, p_partkey AS rid, (p_partkey * 37) % 801 - 400e0 AS x, (p_partkey * 91) % 797 - 398e0 AS y FROM part),
r AS (SELECT p_name, list({'y': y, 'x': x, 'rid': rid} ORDER BY y, x, rid) AS rest, NULL::BIGINT AS rid FROM p GROUP BY p_name
    UNION ALL SELECT p_name, [q FOR q IN rest[2:] IF (q.x - rest[1].x) ** 2 + (q.y - rest[1].y) ** 2 > 22500], rest[1].rid FROM r WHERE len(rest) > 0)
SELECT rid, p_name FROM r WHERE rid IS NOT NULL"""
}
