"""Round 4: cases that queries failed on, each against its SQL or a plain version."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from strider.operators import areas, search, spatial

SF = "/root/testdata/sf0.001"


def both(spark, folder, name, **tables):
    """Rows of a query and of its SQL, as they are, over tables given as SQL; the others are those of the smallest scale."""
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
        made = tables.get(t, f"SELECT * FROM '{SF}/{t}.parquet'")
        con.execute(f"COPY ({made}) TO '{folder}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = entry.queries()[name](spark, str(folder))
    columns = ", ".join(f'"{c}"' for c in df.columns)
    want = con.execute(f"SELECT {columns} FROM ({entry.oracle_sql()[name]})").fetchall()
    return sorted((tuple(r) for r in df.collect()), key=str), sorted(want, key=str)


def test_detour_ratios_of_walks_that_all_but_return(spark, tmp_path):
    """two lines the opposite way, at many angles; the ratio is some 1e16, where the last bit shows how it was rounded."""
    line = "SELECT * REPLACE (i::BIGINT AS l_orderkey, (i + 180 * j)::BIGINT AS l_partkey, (1 + j)::INTEGER AS l_linenumber, 1e0 + i % 50 AS l_quantity)"
    one = f"(SELECT * FROM '{SF}/lineitem.parquet' LIMIT 1)"
    got, want = both(spark, tmp_path, "detour_ratios", lineitem=f"{line} FROM {one}, range(360) a(i), range(2) b(j)")
    assert max(r[1] for r in want if r[1]) > 1e15
    assert got == want


def broadcast_explosions(df):
    """How many broadcasts of a plan hold rows that an explode made: the planner takes them for as few as their table's."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda x: len(x) - len(x.lstrip(" :+-*"))
    found = 0
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            inner = [x for x in lines[i + 1 :]]
            inner = inner[: next((k for k, x in enumerate(inner) if depth(x) <= depth(line)), len(inner))]
            found += any("Generate" in x for x in inner)
    return found


@pytest.mark.parametrize("name", ["nearest_points", "amenities", "named_or_nearest", "owned_names", "crowded_points", "area_or_nearest", "points_in_polygons", "inside_shares", "point_frontage", "snap_pairs", "covered_ways", "shaded_lines"])
def test_nothing_that_exploded_is_broadcast(spark, name):
    """F1, F2, F4, F9, F10, F13 to F16, F17, F18, F22, F5: cells of points, edges or segments went through the driver."""
    assert broadcast_explosions(entry.queries()[name](spark, SF)) == 0


def test_equal_polygons_and_places_are_compared_once_but_all_told(spark):
    """a square with a hole twice, and points twice; each pair is told, the hole is outside."""
    ring = lambda a, b: [(a, a), (b, a), (b, b), (a, b)]
    shapes = [(p, ring(a, b)) for p in (1, 2) for a, b in ((0.0, 10.0), (4.0, 6.0))] + [(3, ring(8.0, 20.0))]
    polygons = spark.createDataFrame(shapes, "poly int, ring array<struct<x: double, y: double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 9.0, 9.0), (4, 9.0, 9.0)], "id int, x double, y double")
    got = sorted(tuple(r) for r in spatial.point_in_polygon(points, polygons, 3.0).collect())
    assert got == [(1, 1), (1, 2), (3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 3)]
    other = spark.createDataFrame([(p, ring(4.5, 5.5)) for p in (7, 8)] + [(9, ring(9.0, 12.0)), (10, ring(30.0, 31.0))], polygons.schema)
    assert sorted(tuple(r) for r in areas.intersecting(polygons, other, 3.0).collect()) == [(1, 9), (2, 9), (3, 9)]


def test_frontage_of_near_far_and_upright_segments(spark):
    """what lies within a sixteenth of the reach, what beyond, ties by segment; against all pairs."""
    segs = [(i, float(i * 7 % 50), float(i * 13 % 50), float(i * 7 % 50 + (i % 3) * 9), float(i * 13 % 50 + (i % 5) * 6)) for i in range(40)]
    segs += [(i + 100, *s) for i, *s in segs[:20]]
    points = [(i, i * 31 % 97 * 1.0, i * 17 % 89 * 1.0) for i in range(200)]
    want = {}
    for p, x, y in points:
        for k, ax, ay, bx, by in segs:
            size = (bx - ax) ** 2 + (by - ay) ** 2
            t = ((x - ax) * (bx - ax) + (y - ay) * (by - ay)) / size if size else 0.0
            d = math.hypot(x - ax - t * (bx - ax), y - ay - t * (by - ay))
            if 0 <= t <= 1 and d <= 16:
                want[p] = min(want.get(p, (99.0, 0)), (round(d, 9), k))
    got = spatial.frontage(spark.createDataFrame(points, "id int, x double, y double"), spark.createDataFrame(segs, "seg int, ax double, ay double, bx double, by double"), 16.0)
    assert {r.id: (round(r.dist, 9), r.seg) for r in got.collect()} == want


@pytest.mark.parametrize("name", ["name_search"])
def test_names_that_repeat_are_searched_as_sql_does(spark, tmp_path, name):
    """parts sixty times over, with shifted keys."""
    part = f"SELECT * REPLACE (p_partkey + i * 20 AS p_partkey) FROM (SELECT * FROM '{SF}/part.parquet' WHERE p_partkey < 20), range(60) r(i)"
    got, want = both(spark, tmp_path, name, part=part)
    assert len(want) >= 600 and got == want


def test_queries_of_the_same_words_are_run_once(spark):
    """F8, F11: each query has its rows, but what is searched is each list of words once, and of docs alike no more than can win."""
    docs = spark.createDataFrame([(i, ["red", "ring"] if i % 2 else ["blue", "rod"], i % 4) for i in range(60)], "doc int, tokens array<string>, prominence int")
    queries = spark.createDataFrame([(i, ["red", "ri"]) for i in range(30)] + [(30, ["blue", "rdo"])], "q int, tokens array<string>")
    seen = []
    run = lambda q: (seen.append(q.count()), search._corrected(docs, q, 5))[1]
    plain = sorted((r.q, r.doc, r["rank"], r.score) for r in search._corrected(docs, queries, 5).collect())
    assert sorted((r.q, r.doc, r["rank"], r.score) for r in search._once(run, queries).collect()) == plain and seen == [2]
    assert sorted((r.q, r.doc, r["rank"], r.score) for r in search.corrected_search(docs, queries, 5).collect()) == plain
    assert search._first_alike(docs, 5).count() == 20
