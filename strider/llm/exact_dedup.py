"""Exact dedup by a tree-merge of sorted digest runs.

Each partition of the scan is a run: one row per digest, sorted, with the document to keep and
the group's size. Runs then merge FAN_IN at a time in rounds, until one is left: the runs of a
merge exchange their rows by (run, digest), each task merges the sorted pieces that it receives
and keeps the smallest verified candidate of each digest, so that every level has at most one
row per run and digest. The root's decision on groups of two or more goes back down to the runs,
where (digest, run) finds the documents again: a text that is a third of the corpus is spread
over as many keys as the scan had partitions, at the leaves and on the way back.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strider.llm.shared import SPACES, keep, once, text_key, whole, without

#: Runs that one merge takes in.
FAN_IN = 8
_KEY = ["digest", "verify"]


def digest_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per row of docs: its normalised text's SHA-256, a second 64-bit hash that
    verifies it, the length of the original text in code points, its text_key, and its run."""
    text = whole(text_col)
    norm = F.translate(text, SPACES, "")
    return docs.select(
        F.col(id_col).alias("doc_id"),
        F.sha2(norm, 256).alias("digest"),
        F.xxhash64(norm).alias("verify"),
        F.length(text).alias("size"),
        text_key(text).alias("h"),
        F.spark_partition_id().alias("run"),
    )


def _merge(runs: DataFrame) -> DataFrame:
    """One sorted run for each number in `run`: the pieces meet, are merged in order, and of each
    digest the smallest candidate stays, with the rows of its group."""
    met = runs.repartition("run", *_KEY).sortWithinPartitions("run", *_KEY)
    return met.groupBy("run", *_KEY).agg(F.min("best").alias("best"), F.sum("n").alias("n"))


def merge_tree(rows: DataFrame, fan_in: int = FAN_IN) -> tuple[DataFrame, DataFrame]:
    """(leaves, root): leaves have a row per digest and run; the root one per digest.

    best is ordered by most code points, then smallest id (null ids last), then text_key.
    """
    first = F.struct((-F.col("size")).alias("less"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")
    # Grouped where the scan left them, before anything is exchanged.
    leaves = rows.groupBy("run", *_KEY).agg(F.min(first).alias("best"), F.count(F.lit(1)).alias("n"))
    leaves = keep(leaves.sortWithinPartitions("run", *_KEY), "digest_runs")
    level, left = leaves, (leaves.agg(F.max("run")).first()[0] or 0) + 1
    while left > 1:
        left = -(-left // fan_in)
        level = _merge(level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int")))
    return leaves, level.drop("run")


def _decided(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = keep(digest_rows(docs, id_col, text_col), "digests")
    leaves, root = merge_tree(rows)
    groups = keep(root.where("n > 1").select(*_KEY, F.struct("best.doc_id", "best.h").alias("stays"), F.col("n").alias("group_size")), "groups")
    decided = leaves.select(*_KEY, "run").join(groups, _KEY)
    return rows.join(decided, [*_KEY, "run"], "left").select(
        "doc_id",
        "h",
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("stays").isNull() | F.struct("doc_id", "h").eqNullSafe(F.col("stays"))).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of docs.

    Texts are equal when identical without white space; null counts as empty, and empty texts
    form a group. Of a group the longest original text stays, then the smallest id (a null id is
    the largest), then the text with the least hash. Rows that repeat both id and text all carry
    the decision on them. Very long texts are digested whole. An empty table gives no rows; other
    columns of docs are ignored, whatever their names.
    """
    return _decided(docs, id_col, text_col).drop("h")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each group of equal texts, in docs' own columns.

    Rows that repeat both id and text stand once afterwards; where an id has other texts too,
    these stay. Null ids are treated like any other id."""
    gone = _decided(docs, id_col, text_col).where(~F.col("kept")).select("doc_id", "h")
    return once(without(docs, gone, id_col, text_col), id_col, text_col)


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM documents),
w AS (SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY length(text) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
