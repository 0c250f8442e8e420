"""Scans that read no more than the filter asks for."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from strider.operators import permits, places
from strider.sources import files
from strider.sources.pages import KeyedSource


def test_feed_lines_are_kept_as_they_are_read(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("stop_times.txt", "trip_id,stop_id\nt1,A\nt2,B\n t1 ,C\nt3,D\n")
    read = lambda keep: sorted(r.row["stop_id"] for r in files.read_gtfs_table(spark, str(tmp_path / "feed.zip"), "stop_times", keep).collect())
    assert read(None) == ["A", "B", "C", "D"] and read({"trip_id": {"t1"}}) == ["A", "C"]
    assert read({"trip_id": {"t1", "t3"}, "stop_id": {"D"}}) == ["D"] and read({"none": {"x"}}) == []


def test_box_reaches_the_scan_and_skips_row_groups(spark, tmp_path):
    df = spark.range(200_000).select((F.col("id") / 100).alias("x"), (F.col("id") % 100).cast("double").alias("y"), "id")
    df.coalesce(1).write.option("parquet.block.size", 65536).option("parquet.page.row.count.limit", 2000).parquet(str(tmp_path / "p"))
    got = files.read_box(spark, str(tmp_path / "p"), ("x", "y"), (10.0, 5.0, 12.0, 50.0))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(x), IsNotNull(y), GreaterThan(x,10.0), GreaterThan(y,5.0), LessThan(x,12.0), LessThan(" in plan  # the plan's text ends there
    assert got.count() == sum(10 < i / 100 < 12 and 5 < i % 100 < 50 for i in range(200_000))
    executed = got.select("id")
    executed.collect()
    scan = executed._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert scan.metrics().apply("numOutputRows").value() < 150_000  # whole row groups were not read


def test_lookups_go_by_batches_of_keys(spark, tmp_path):
    for k in range(0, 500, 2):
        (tmp_path / f"{k}.json").write_text(json.dumps([{"k": k}, {"k": -k}]))
    spark.dataSource.register(KeyedSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        load = lambda: spark.read.format("keyed").option("path", str(tmp_path)).load()
        some = load().where(F.col("id").isin([str(k) for k in range(450)]))
        assert some.rdd.getNumPartitions() == 3 and some.count() == 450
        assert {r.id for r in load().where("id = '4' AND body LIKE '%-4%'").collect()} == {"4"}
        assert load().where(F.col("id").isin("1", "3")).count() == 0
        with pytest.raises(Exception, match="a lookup needs ids"):
            load().collect()
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_places_come_back_from_their_lines(spark, tmp_path):
    df = spark.createDataFrame([("b", 1.0, None), ("a", 2.0, "cafe")], "name string, x double, kind string")
    files.write_places(df, str(tmp_path / "p"), ["name"])
    ddl = "name string, x double, kind string"
    assert sorted(map(tuple, files.read_places(spark, str(tmp_path / "p"), ddl).collect())) == [("a", 2.0, "cafe"), ("b", 1.0, None)]
    (tmp_path / "bad").write_text('{"name": "a"}\n{broken\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_places(spark, str(tmp_path / "bad"), ddl).collect()


def test_the_area_of_least_size_holds_the_point(spark):
    ring = lambda s: [(-s, -s), (s, -s), (s, s), (-s, s)]
    areas = spark.createDataFrame([(1, ring(50.0)), (2, ring(10.0)), (3, ring(30.0))], "poly long, ring array<struct<x:double,y:double>>")
    points = spark.createDataFrame([(1, 1.0, 1.0), (2, 20.0, 1.0), (3, 40.0, 1.0), (4, 90.0, 1.0)], "id long, x double, y double")
    near = spark.createDataFrame([(9, 95.0, 1.0, 7)], "rid long, x double, y double, area long")
    assert {r.id: r.area for r in places.area_or_nearest(points, areas, near, 20.0, 10.0).collect()} == {1: 2, 2: 3, 3: 1, 4: 7}


def test_garbled_rows_with_one_open_place(spark):
    records = spark.createDataFrame([(1, "b", "1", "s", None), (2, "b", "1", "s", None), (3, "c", "2", "t", "x"), (4, None, "2", "t", "x")], "job long, bin string, house string, street string, first_permit string")
    listed = spark.createDataFrame([(1, 1), (3, 3)], "day long, job long")
    rows = [(10, 1, "b", "1", "s", None), (11, 2, "b", "1", "s", None), (12, 2, "c", "2", "t", "x"), (13, 2, "c", "2", "t", "x"), (14, 3, "c", "2", "t", "x"), (15, 1, None, "2", "t", "x")]
    garbled = spark.createDataFrame(rows, "row long, day long, bin string, house string, street string, first_permit string")
    assert sorted(map(tuple, permits.recovered(garbled, listed, records).collect())) == [(10, 1, 2), (12, 2, 3), (15, 1, 4)]


def test_a_blank_lot_is_no_move(spark):
    rows = [("a", 1, "7", "s", "1/2"), ("a", 2, "7", "s", ""), ("a", 3, "7", "s", "1/2"), ("a", 4, "7", "t", ""), ("a", 5, None, "t", None), ("b", 1, None, None, None), ("b", 2, None, None, "9")]
    df = spark.createDataFrame([(*r, 1.0, None, 3.0) for r in rows], "job string, day int, bin string, street string, bbl string, lat double, lng double, feet double")
    assert sorted(map(tuple, permits.moved(df).collect())) == [("a", 1), ("a", 4), ("a", 5), ("b", 1), ("b", 2)]
