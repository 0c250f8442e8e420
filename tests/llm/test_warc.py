import base64
import gzip
import hashlib

from conftest import SF
from pyspark.sql import functions as F

from strider.llm import warc


def brute(rows):
    """page_id -> (bytes, digest, type, refers_to), from the html alone."""
    groups = {}
    for i, html in rows:
        groups.setdefault((html or "").encode(), []).append(i)
    out = {}
    for payload, ids in groups.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for i in ids:
            out[i] = (len(payload), digest, "response" if i == max(ids) else "revisit", None if i == max(ids) else max(ids))
    return out


def test_round_trip_against_brute_force(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    rows = [(r.page_id, r.html) for r in pages.collect()]
    rows += [(1000, None), (1001, ""), (1002, "same"), (1003, "same"), (1004, "x" * 300_000)]
    df = spark.createDataFrame([(i, f"http://a b/\r\n{i}", h, "clash") for i, h in rows], "page_id long, url string, html string, record_type string")
    got = {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect()}
    assert got == brute(rows)
    texts = {r.page_id: r.payload for r in warc.round_trip(df).where("record_type = 'response'").collect()}
    assert all(texts[i].decode() == (h or "") for i, h in rows if i in texts)


def test_smaller_payloads_are_all_responses(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, None, "abcdef"), (4, None, "abcdef")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in warc.round_trip(df, min_bytes=3).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}


def test_nulls_repeats_and_empty_table(spark):
    df = spark.createDataFrame([(None, None, None), (5, "u", "t"), (5, "u", "t")], "page_id long, url string, html string")
    got = sorted((str(r.page_id), r.record_type, r.payload_bytes) for r in warc.round_trip(df).collect())
    assert got == [("5", "response", 1), ("5", "response", 1), ("None", "response", 0)]
    assert warc.round_trip(df.where("false")).count() == 0


def test_ranges_join_and_archives_are_plain_gzip_members(spark):
    df = spark.range(40).select(F.col("id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("id").cast("string").alias("html"))
    index = warc.write_archives(warc.plan_records(df))
    rows = [r.asDict() for r in index.orderBy("file", "offset").collect()]
    assert len(list(warc.coalesce_ranges(rows))) == len({r["file"] for r in rows})
    assert len(list(warc.coalesce_ranges(rows, most=1))) == 40
    one = rows[0]["file"].removeprefix("file:").replace("//", "/")
    assert gzip.open(one).read().count(b"WARC/1.1\r\n") == sum(r["file"] == rows[0]["file"] for r in rows)
    some = warc.read_records(index.where("page_id % 7 = 0"))
    assert sorted(r.page_id for r in some.collect()) == [0, 7, 14, 21, 28, 35]
