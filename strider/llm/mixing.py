"""Mixes sources to target weights by capped water-filling and seeded repetitions.

1. A scan gives each document's size and a seeded hash; these rows (no text) are a table of the
   shared folder, and their sums by source, made in part first, another.
2. Water-filling: a source whose share at the present level exceeds its cap (its size times
   `max_epochs`) is clamped to it; what it leaves raises the level of the others, until none exceeds.
3. A document is taken floor(target / source size) times, and once more if it is among the first of
   its source by hash, as far as these come nearest to the rest of the target. Buckets of the hash
   are summed first, then only the bucket in which the rest ends is looked at by hash, and only
   rows that repeat one id at the very end are numbered; no source meets in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strider.llm.shared import BROADCAST_IDS, keep, whole

#: Fixed: words of the contract.
WORDS = r"[^\x20\x09-\x0D]+"
BUCKET_DIGITS = 3
_SALTS = 64


def _ranked(df: DataFrame, column: str) -> DataFrame:
    """df, sorted by column (code points, null last) across partitions, with position from 0."""
    rows = keep(df.orderBy(F.asc_nulls_last(column)).withColumn("_row", F.monotonically_increasing_id()), "sorted")
    part, inner = F.shiftright("_row", 33), F.col("_row").bitwiseAND((1 << 33) - 1)
    rows = rows.withColumn("_part", part)
    # One row a partition.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return rows.join(F.broadcast(starts), "_part").withColumn("position", F.col("_start") + inner).drop("_part", "_row", "_n", "_start")


def water_level(sources: DataFrame, total: float, cap: Column | str, weight: Column | str) -> float:
    """The level l at which the sum of min(cap, l * weight) is total; infinite if the caps hold less.

    Each round is one aggregate; the level only rises, so there are no more rounds than sources."""
    level, cap, weight = -1.0, F.expr(cap) if isinstance(cap, str) else cap, F.expr(weight) if isinstance(weight, str) else weight
    while True:
        full = cap <= F.lit(level) * weight
        left, free = sources.agg(F.sum(F.when(full, cap).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(weight))).first()
        if not free:
            return float("inf")
        found = (total - left) / free
        if found <= level:
            return level
        level = found


def targets(sizes: DataFrame, weights: tuple[float, ...], total_percent: float, max_epochs: float) -> DataFrame:
    """source, source_size, target. The sources in order of code points, null last, weigh as weights,
    which repeat; together they get total_percent of all sizes, none more than max_epochs of its own."""
    ranked = keep(_ranked(sizes, "source"), "sources")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level = water_level(ranked, total * total_percent / 100, cap, weight)
    return ranked.select("source", "source_size", F.least(cap, F.lit(level) * weight).alias("target"))


def _with_targets(rows: DataFrame, found: DataFrame, few: bool) -> DataFrame:
    """rows joined with a table that has a row a source; a source of very many rows is dealt out."""
    found = found.withColumnRenamed("source", "_source")
    if few:
        return rows.join(F.broadcast(found), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    salted = found.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    rows = rows.withColumn("_of", F.pmod(F.xxhash64("doc_id", "hash"), F.lit(_SALTS)).cast("int"))
    return rows.join(salted, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_of") == F.col("_salt"))).drop("_source", "_salt", "_of")


def mix(
    docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), total_percent: float = 150, max_epochs: float = 2, seed: int = 13,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", broadcast_sources: int = BROADCAST_IDS // 20,
) -> DataFrame:
    """doc_id, size (words), source_size, target (of its source), taken (words the mix takes of the
    row, repetitions counted) for every row of docs; taken / size is how often the row is in the mix.

    Null texts are empty; a null source is one of its own, in last place. Documents are taken whole, so
    a source misses its target by half of one document at most. Rows that repeat are documents of
    their own; ids are whole numbers and may repeat or be null (which of the rows that share id
    and size is taken once more may differ between layouts of the input, their number not). Very
    long texts are counted whole; an empty table gives no rows. Other columns of docs are ignored."""
    if min(weights) <= 0 or total_percent > 100 * max_epochs:
        raise ValueError("weights are positive, and the caps must hold the total")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), whole(text_col).alias("text"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = keep(rows.select("doc_id", "source", F.regexp_count("text", F.lit(WORDS)).cast("long").alias("size"), digest.alias("hash")), "sizes")
    bucket = F.substring("hash", 1, BUCKET_DIGITS)
    buckets = keep(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")), "buckets")
    goal = keep(targets(buckets.groupBy("source").agg(F.sum("size").alias("source_size")), weights, total_percent, max_epochs), "targets")
    few = goal.count() <= broadcast_sources
    goal = goal.withColumn("times", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("times") * F.col("source_size"))

    # The bucket in which a source's rest ends, and the words of the buckets before it.
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = buckets.withColumn("before", F.sum("size").over(running) - F.col("size"))
    ends = _with_targets(ends.withColumn("doc_id", F.lit(0)).withColumn("hash", F.col("bucket")), goal, few)
    # The greatest bucket that begins below the rest; none if the rest is 0.
    ends = ends.where(F.col("before") < F.col("rest")).groupBy("source").agg(F.max_by(F.struct("bucket", "before"), "bucket").alias("end"))
    goal = keep(goal.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").select("*", "end.bucket", "end.before").drop("end"), "ends")

    rows = _with_targets(rows, goal, few)
    sure = F.when(F.col("bucket").isNull() | (bucket > F.col("bucket")), 0).when(bucket < F.col("bucket"), 1)
    rows = rows.withColumn("once", sure)
    last = rows.where(F.col("once").isNull())
    # Rows of one hash and size are one group of n equal rows; n counts in part before the shuffle.
    groups = last.groupBy("source", "hash", F.col("size").alias("_size")).agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    by_hash = Window.partitionBy("source").orderBy("hash", "_size").rowsBetween(Window.unboundedPreceding, 0)
    room = F.col("rest") - F.col("before") - F.sum(F.col("n") * F.col("_size")).over(by_hash) + F.col("n") * F.col("_size")
    # The i-th of the equal rows goes in if more than half of it fits: (i - 1/2) * size < room.
    fits = F.when(F.col("_size") == 0, F.lit(0)).otherwise(F.ceil(F.col("room") / F.col("_size") + F.lit(0.5)) - F.lit(1))
    groups = keep(groups.withColumn("room", room).withColumn("fit", F.greatest(F.lit(0), F.least(F.col("n"), fits))).select("source", "hash", "_size", "n", "fit"), "last_groups")
    split = groups.where((F.col("fit") > 0) & (F.col("fit") < F.col("n")))  # one a source at most
    same = [F.col("source").eqNullSafe(F.col("_s")), F.col("hash") == F.col("_h"), F.col("size") == F.col("_size")]
    as_side = lambda df: df.withColumnRenamed("source", "_s").withColumnRenamed("hash", "_h")
    whole_groups = as_side(groups.where((F.col("fit") == 0) | (F.col("fit") == F.col("n"))).withColumn("once_", (F.col("fit") > 0).cast("int")).drop("n", "fit"))
    split = as_side(split.select("source", "hash", "_size", "fit"))

    at_ends = last.drop("once").join(F.broadcast(whole_groups) if few else whole_groups, same).withColumnRenamed("once_", "once")
    # Rows of a group that goes in in part: numbered within each partition of the scan, after those before it.
    at_split = keep(last.drop("once").join(F.broadcast(split) if few else split, same).withColumn("_part", F.spark_partition_id()), "split_rows")
    starts = at_split.groupBy("source", "_part").agg(F.count(F.lit(1)).alias("_n"))
    starts = starts.withColumn("_start", F.sum("_n").over(Window.partitionBy("source").orderBy("_part")) - F.col("_n")).select(F.col("source").alias("_s2"), F.col("_part").alias("_p2"), "_start")
    numbered = at_split.withColumn("_i", F.row_number().over(Window.partitionBy("source", "_part").orderBy("doc_id")))
    numbered = numbered.join(starts, F.col("source").eqNullSafe(F.col("_s2")) & (F.col("_part") == F.col("_p2")))
    numbered = numbered.withColumn("once", (F.col("_start") + F.col("_i") <= F.col("fit")).cast("int"))

    out = ["doc_id", "size", "source_size", "target", ((F.col("times") + F.col("once")) * F.col("size")).alias("taken")]
    return rows.where(F.col("once").isNotNull()).select(*out).unionAll(at_ends.select(*out)).unionAll(numbered.select(*out))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rn, doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('13:' || coalesce(doc_id::VARCHAR, '')) AS hash FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INTEGER]::DOUBLE AS w FROM d GROUP BY source),
f AS (SELECT *, 2.0::DOUBLE * source_size AS cap, sum(source_size) OVER ()::DOUBLE * 150 / 100 AS total,
    sum(2.0::DOUBLE * source_size) OVER o - 2.0::DOUBLE * source_size AS clamped, sum(w) OVER () - sum(w) OVER o + w AS free
    FROM s WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (SELECT max((total - clamped) / free) AS level FROM f),
t AS (SELECT source, source_size, least(cap, level * w) AS target,
    CASE WHEN source_size > 0 THEN floor(least(cap, level * w) / source_size) ELSE 0 END::BIGINT AS times FROM f, l),
c AS (SELECT d.*, source_size, target, times, target - times * source_size AS rest,
    sum(size) OVER (PARTITION BY d.source ORDER BY hash, size, rn ROWS UNBOUNDED PRECEDING) AS upto FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (times + (upto - size / 2.0::DOUBLE < rest)::INTEGER) * size AS taken FROM c
"""
