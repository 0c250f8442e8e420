"""Graphs as edge tables. Iterations write each round to checkpoint storage, so lineage stays short."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """df, computed and cut from its lineage in the cluster's shared checkpoint folder."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        shared = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-"))  # one machine: its own folder is shared
    return df.checkpoint()


def both_ways(edges: DataFrame) -> DataFrame:
    """Edges (a, b, w) in either direction."""
    return edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("length"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node), by large-star and small-star contraction."""
    now, mark = settled(edges.select("a", "b").where("a <> b").distinct()), None
    while True:
        either = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = either.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = either.where("b > a").join(low, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
        hung = down.join(low, F.col("a") == F.col("u"))
        now = settled(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(hung.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        got = tuple(now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if got == mark:
            break
        mark = got
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    return nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def shortest_within(edges: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """node, dist, parent from the nearest of seeds (node, dist), up to radius, over edges (a, b, w).

    Label-correcting rounds: only nodes that came nearer spread again; a round is one join and one
    min, until none does. Weights are not negative, so rounds end. Of several parents at the same
    distance the smallest stands (only over edges with a weight, so that parents lead to a seed)."""
    adjacency = settled(edges.select("a", "b", "w"))
    if not adjacency.where("w < 0").isEmpty():
        raise ValueError("edges with negative weights")
    best = settled(seeds.select("node", F.col("dist").cast("double").alias("dist"), F.lit(None).cast("bigint").alias("parent")))
    front = best.select("node", "dist")
    while True:
        step = front.join(adjacency, front["node"] == adjacency["a"]).select(F.col("b").alias("node"), "w", F.struct((F.col("dist") + F.col("w")).alias("dist"), F.col("a").cast("bigint").alias("parent")).alias("m")).where(F.col("m.dist") <= radius)
        step = step.groupBy("node").agg(F.min("m").alias("m"), F.min(F.when(F.col("w") > 0, F.col("m"))).alias("tie"))
        old = best.select("node", F.col("dist").alias("od"), F.col("parent").alias("op"))
        nearer = F.col("od").isNull() | (F.col("m.dist") < F.col("od"))
        tied = (F.col("tie.dist") == F.col("od")) & (F.col("tie.parent") < F.col("op"))
        found = step.join(old, "node", "left").where(nearer | tied).select("node", F.when(nearer, F.col("m")).otherwise(F.col("tie")).alias("m"), nearer.alias("nearer"))
        found = settled(found.select("node", "m.dist", "m.parent", "nearer"))
        if found.isEmpty():
            return best
        best = settled(best.join(found.select("node"), "node", "left_anti").unionByName(found.drop("nearer")))
        front = found.where("nearer").select("node", "dist")


def collapse_parallel(edges: DataFrame, prefer: list) -> DataFrame:
    """One edge for each unordered pair of nodes, the first by `prefer`; loops go."""
    from pyspark.sql import Window

    w = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy(*prefer)
    return edges.where("a <> b").withColumn("_i", F.row_number().over(w)).where("_i = 1").drop("_i")


def nodes_with_only(edges: DataFrame, kind: str) -> DataFrame:
    """Nodes all of whose edges are of a kind."""
    ends = edges.select(F.col("a").alias("node"), "kind").unionByName(edges.select(F.col("b").alias("node"), "kind"))
    return ends.groupBy("node").agg(F.bool_and(F.col("kind") == kind).alias("only")).where("only").select("node")


def anchored(edges: DataFrame, anchors: DataFrame) -> DataFrame:
    """Edges of components that hold an anchor (node); islands go."""
    c = components(edges)
    held = c.join(anchors.select("node"), "node", "left_semi").select("component").distinct()
    return edges.join(c.join(held, "component", "left_semi").select(F.col("node").alias("a")), "a", "left_semi")


def chains(edges: DataFrame) -> DataFrame:
    """Edges (edge, a, b, w, key) with the chain they contract into: neighbours that meet, with
    the same key, at a node of degree two. chain is the chain's smallest edge."""
    ends = edges.select("edge", F.col("a").alias("node"), "key").unionByName(edges.select("edge", F.col("b").alias("node"), "key"))
    through = ends.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("edge").alias("a"), F.max("edge").alias("b"), F.count_distinct("key").alias("k")).where("n = 2 AND k = 1 AND a <> b")
    joined = components(through.select("a", "b"))
    return edges.join(joined.withColumnsRenamed({"node": "edge", "component": "chain"}), "edge", "left").withColumn("chain", F.coalesce("chain", "edge"))


def timed_labels(edges: DataFrame, departures: DataFrame, seeds: DataFrame, horizon: float) -> DataFrame:
    """node, at: earliest arrivals. Edges (a, b, w) are walked; departures (a, b, dep, arr) are
    rides; any that leaves a not before the arrival there may be the best one. Rounds
    go on until no node improves; no walk or ride takes negative time, so they end."""
    walk, rides = settled(edges.select("a", "b", "w")), settled(departures.select("a", "b", "dep", "arr"))
    if not walk.where("w < 0").isEmpty() or not rides.where("arr < dep").isEmpty():
        raise ValueError("walks or rides of negative time")
    best = settled(seeds.select("node", F.col("at").cast("double").alias("at")))
    front = best
    while True:
        walked = front.join(walk, front["node"] == walk["a"]).select(F.col("b").alias("node"), (F.col("at") + F.col("w")).alias("na"))
        ridden = front.join(rides, (front["node"] == rides["a"]) & (rides["dep"] >= front["at"])).select(F.col("b").alias("node"), F.col("arr").cast("double").alias("na"))
        step = walked.unionByName(ridden).where(F.col("na") <= horizon).groupBy("node").agg(F.min("na").alias("na"))
        front = settled(step.join(best.withColumnRenamed("at", "old"), "node", "left").where(F.col("old").isNull() | (F.col("na") < F.col("old"))).select("node", F.col("na").alias("at")))
        if front.isEmpty():
            break
        best = settled(best.join(front.select("node"), "node", "left_anti").unionByName(front))
    return best
