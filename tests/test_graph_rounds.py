"""Distances and arrivals over paths of many edges."""

import pytest

from strider.operators import graph


def test_long_paths_are_followed_to_the_end(spark):
    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(70)], "a bigint, b bigint, w double")
    seeds = spark.createDataFrame([(0, 0.0)], "node bigint, v double")
    got = {r.node: r.dist for r in graph.shortest_within(edges, seeds.withColumnRenamed("v", "dist"), 68.0).collect()}
    assert got == {i: float(i) for i in range(69)}
    rides = spark.createDataFrame([(70, 71, 80.0, 90.0), (71, 72, 89.0, 91.0)], "a bigint, b bigint, dep double, arr double")
    got = {r.node: r.at for r in graph.timed_labels(edges, rides, seeds.withColumnRenamed("v", "at"), 100.0).collect()}
    assert got == {i: float(i) for i in range(71)} | {71: 90.0}


def test_negative_weights_are_refused(spark):
    edges = spark.createDataFrame([(0, 1, -1.0), (1, 0, -1.0)], "a bigint, b bigint, w double")
    seeds = spark.createDataFrame([(0, 0.0)], "node bigint, dist double")
    with pytest.raises(ValueError):
        graph.shortest_within(edges, seeds, 5.0)
