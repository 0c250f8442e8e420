"""Tables that several stages read, kept in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed: the white space of all the text contracts, [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side may be broadcast up to this many bytes (counted before it is sent).
BROADCAST_BYTES = 64 << 20
#: The same for tables of one id, in rows.
BROADCAST_IDS = 2_000_000


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a folder of our own only on one machine without it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        found = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/strider-{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table of the shared folder and read it again: later stages start from
    files that survive lost executors, and nothing upstream runs twice."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, UPPER.lower())


def whole(c: Column | str) -> Column:
    """A text column in which null counts as empty."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(c: Column | str) -> Column:
    """With the id it names a row: rows that agree in both are repeats of one another."""
    return F.xxhash64(whole(c))


def _meet(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, how: str, distinct: bool = False) -> DataFrame:
    """docs joined with (_id, _key) rows by id (null equals null) and text; distinct: once each."""
    # Under other names while the join runs: the columns of docs may have any.
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.toDF(*names.values())
    same = F.col(names[id_col]).eqNullSafe(F.col("_id")) & (text_key(names[text_col]) == F.col("_key"))
    out = rows.join(keys, same, how)
    if distinct:
        out = out.withColumn("_key", text_key(names[text_col])).dropDuplicates([names[id_col], "_key"]).drop("_key")
    return out.toDF(*names)


def without(docs: DataFrame, gone: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that gone (id, text_key) names; another text of the same id stays.

    gone is counted first: up to BROADCAST_IDS rows go to all tasks, and no text is shuffled."""
    keys = keep(gone.toDF("_id", "_key").distinct(), "gone")
    n = keys.count()
    return docs if n == 0 else _meet(docs, F.broadcast(keys) if n <= BROADCAST_IDS else keys, id_col, text_col, "left_anti")


def once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs in which rows that agree in id and text (null counts as empty) stand once. Only such rows
    are shuffled whole."""
    keys = docs.select(F.col(id_col).alias("_id"), text_key(text_col).alias("_key"))
    keys = keep(keys.groupBy("_id", "_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "repeats")
    n = keys.count()
    if n == 0:
        return docs
    keys = F.broadcast(keys) if n <= BROADCAST_IDS else keys
    return _meet(docs, keys, id_col, text_col, "left_anti").unionAll(_meet(docs, keys, id_col, text_col, "left_semi", distinct=True))


def give_back() -> None:
    """Ends a task's Python part: its worker lives on, and should not keep what the task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)
