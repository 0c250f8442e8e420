"""Readers and sinks for the files that feed a build."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """Quoted CSV with a header; quotes may hold line breaks, a byte-order mark is no letter."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def either(df: DataFrame, names: list[str]) -> Column:
    """The first of the columns that the file has and that isn't blank there."""
    found = [F.nullif(F.trim(F.col(f"`{n}`")), F.lit("")) for n in names if n in df.columns]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    """job, bin, street, date_text and the file's day: the date most of its rows state."""
    raw = read_csv(spark, path).withColumn("file", F.input_file_name())
    rows = raw.select("file", either(raw, ["Job Number", "job", "JOB_NO"]).alias("job"), either(raw, ["BIN", "bin"]).alias("bin"), either(raw, ["Street", "street_name"]).alias("street"), either(raw, ["Date", "as_of"]).alias("date_text"))
    day = rows.groupBy("file", "date_text").count().groupBy("file").agg(F.min_by("date_text", F.struct(-F.col("count"), F.col("date_text"))).alias("day"))
    return rows.join(F.broadcast(day), "file")


def read_gtfs_table(spark: SparkSession, path: str, table: str, keep: dict[str, set[str]] | None = None) -> DataFrame:
    """feed and row (a map) of one table of zipped feeds, wherever in the zip it lies.

    keep (column: values) is tested on each line as it is read: other lines become no rows, as when only the stop
    times of some trips are wanted out of a feed's largest table. The values go to all tasks, so they should be few."""

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in frames:
            for name, content in zip(p["path"], p["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    member = next((n for n in z.namelist() if n.rsplit("/", 1)[-1] == f"{table}.txt"), None)
                    if member is None:
                        continue
                    lines = csv.DictReader(io.TextIOWrapper(z.open(member), "utf-8-sig", newline=""))
                    rows = []
                    for r in lines:
                        if any((r.get(c) or "").strip() not in values for c, values in (keep or {}).items()):
                            continue
                        rows.append((name.rsplit("/", 1)[-1], {k.strip(): v.strip() for k, v in r.items() if k and v is not None}))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["feed", "row"])
                            rows = []
                    yield pd.DataFrame(rows, columns=["feed", "row"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(unpack, "feed string, row map<string,string>")


def read_box(spark: SparkSession, path: str, columns: tuple[str, str], box: tuple[float, float, float, float]) -> DataFrame:
    """Rows of parquet files inside a box (least x, least y, greatest x, greatest y; bounds excluded), by two plain columns.

    The bounds are comparisons with constants, so they reach the scan: row groups whose statistics lie outside are not
    read. Files sorted by place (hilbert order, say) leave few that are."""
    x, y = (F.col(c) for c in columns)
    return spark.read.parquet(path).where((x > box[0]) & (y > box[1]) & (x < box[2]) & (y < box[3]))


def read_places(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of JSON lines; a line that is no JSON of the schema ends the job, as no place may be lost unseen."""
    return spark.read.option("mode", "FAILFAST").schema(schema).json(path)


def write_places(df: DataFrame, path: str, order: list[str]) -> None:
    """JSON lines, sorted within each file; absent values have no key."""
    df.sortWithinPartitions(*order).write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """id, properties, ring: the outer rings of newline-separated GeoJSON polygons and multipolygons."""
    ddl = "id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
    rows = spark.read.text(path).select(F.from_json("value", ddl).alias("f")).select("f.*")
    one, many = "array<array<array<double>>>", "array<array<array<array<double>>>>"
    parts = F.when(F.col("geometry.type") == "Polygon", F.array(F.from_json("geometry.coordinates", one))).otherwise(F.from_json("geometry.coordinates", many))
    rows = rows.select("id", "properties", F.explode(parts).alias("rings"))
    return rows.select("id", "properties", F.transform(F.get("rings", F.lit(0)), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y"))).alias("ring"))


def wkt_point(text: Column) -> Column:
    number = r"(-?\d+(?:\.\d+)?)"
    part = lambda i: F.nullif(F.regexp_extract(text, rf"(?i)^\s*POINT\s*\(\s*{number}\s+{number}\s*\)", i), F.lit("")).try_cast("double")
    return F.struct(part(1).alias("x"), part(2).alias("y"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated permits with nested cells: runs '2026-01-02..2026-02-03,2026-03-01..'."""
    raw = spark.read.csv(path, sep="\t", header=True)
    runs = F.transform(F.filter(F.split("runs", ","), lambda r: r != ""), lambda r: F.struct(F.get(F.split(r, r"\.\."), F.lit(0)).try_cast("date").alias("first"), F.nullif(F.get(F.split(r, r"\.\."), F.lit(1)), F.lit("")).try_cast("date").alias("last")))
    return raw.withColumn("runs", runs)


def write_history(df: DataFrame, path: str) -> None:
    text = F.concat_ws(",", F.transform("runs", lambda r: F.concat(r["first"].cast("string"), F.lit(".."), F.coalesce(r["last"].cast("string"), F.lit("")))))
    df.withColumn("runs", text).write.mode("overwrite").csv(path, sep="\t", header=True)


def write_tiles(df: DataFrame, path: str) -> None:
    """Rows with tile columns x and y, a folder for each tile; a reader prunes to those it asks for."""
    df.repartition("x", "y").write.mode("overwrite").partitionBy("x", "y").parquet(path)


def publish(history: DataFrame, body: DataFrame, day: str) -> DataFrame:
    """history (first, last, hash) with a new record from `day` on, if its body's hash is new:
    the open record then ends the day before."""
    # An order-free digest of the rows, so nothing is gathered to be hashed.
    digest = F.concat_ws(":", F.bit_xor(F.xxhash64(*body.columns)).cast("string"), F.sum(F.xxhash64(F.lit(1), *body.columns) % 1_000_003).cast("string"), F.count(F.lit(1)).cast("string"))
    new = body.agg(F.sha2(digest, 256).alias("hash"))
    d = F.lit(day).cast("date")
    current = history.where("last IS NULL").select(F.col("hash").alias("now"))
    changed = new.join(current, new["hash"] == current["now"], "left_anti").select(d.alias("first"), F.lit(None).cast("date").alias("last"), "hash")
    marked = history.join(F.broadcast(changed.select(F.lit(True).alias("_changed"))), F.lit(True), "left")
    kept = marked.select("first", F.when(F.col("last").isNull() & F.col("_changed"), F.date_sub(d, 1)).otherwise(F.col("last")).alias("last"), "hash")
    return kept.unionByName(changed)
