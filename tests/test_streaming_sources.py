import datetime as dt
import json
import random
import zipfile

from pyspark.sql import functions as F

from strider.operators import permits, search, transit
from strider.sources import files
from strider.sources.pages import PagedSource
from strider.streaming import fold

DAY = dt.date(2026, 3, 2)


def snapshots():
    """Permits that stay, end, return and flap; day 25 is truncated, day 30 silent."""
    rnd, rows = random.Random(3), []
    listed = {f"j{i}": (rnd.randrange(0, 30), rnd.randrange(30, 60)) for i in range(20)}
    for n in range(60):
        if n == 30:
            continue
        jobs = [j for j, (a, b) in listed.items() if a <= n <= b and not (j == "j3" and 35 <= n <= 40)] + [f"s{i}" for i in range(15)]
        for j in jobs[:2] if n == 25 else jobs:
            rows.append((DAY + dt.timedelta(days=n), j))
    return rows


def by_hand(rows):
    days = {}
    for d, j in rows:
        days.setdefault(d, set()).add(j)
    counts, runs, seen = [], {}, None
    for d in sorted(days):
        near = sorted(counts[-30:])
        median = near[len(near) // 2] if near else 0
        counts.append(len(days[d]))
        if median and counts[-1] < 0.75 * median:
            continue
        for j in days[d]:
            if not runs.get(j) or runs[j][-1][1] is not None:
                runs.setdefault(j, []).append([d, None])
        for j, r in runs.items():
            if r[-1][1] is None and j not in days[d]:
                r[-1][1] = seen
        seen = d
    return {(j, *r) for j, rs in runs.items() for r in rs}


def test_batch_and_stream_fold_alike(spark, tmp_path):
    rows = snapshots()
    want = by_hand(rows)
    df = spark.createDataFrame(rows, "day date, job string")
    assert {tuple(r) for r in permits.permit_runs(df).collect()} == want
    source = tmp_path / "in"
    for n, part in enumerate((rows[:50], rows[50:60], rows[60:110])):
        spark.createDataFrame(part, "day date, job string").coalesce(1).write.parquet(str(source / str(n)))
    target = fold.SnapshotFold(spark, str(tmp_path / "state"))
    for n in range(3):
        target(spark.read.parquet(str(source / str(n))), n)
    # The batch that cuts a day in two sees its rest come late.
    cut = rows[49][0]
    kept = [r for k, r in enumerate(rows) if k < 110 and not (k >= 50 and r[0] <= cut) and not (k >= 60 and r[0] <= rows[59][0])]
    assert {tuple(r) for r in target.state(2)[1].collect()} == by_hand(kept)


def test_stream_runs_through_foreach_batch(spark, tmp_path):
    rows = snapshots()[:60]
    spark.createDataFrame(rows, "day date, job string").coalesce(1).write.parquet(str(tmp_path / "in"))
    target = fold.SnapshotFold(spark, str(tmp_path / "state"))
    stream = spark.readStream.schema("day date, job string").parquet(str(tmp_path / "in"))
    stream.writeStream.foreachBatch(target).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert {tuple(r) for r in target.state(0)[1].collect()} == by_hand(rows)


def test_standing_stretch(spark):
    d = lambda n: DAY + dt.timedelta(days=n)
    runs = spark.createDataFrame([("a", d(0), d(5)), ("a", d(15), d(20)), ("a", d(60), None), ("b", d(0), d(1))], "job string, first date, last date")
    got = {tuple(r) for r in permits.standing(runs, str(d(10)), str(d(70))).collect()}
    assert got == {("a", d(0), d(20))}
    assert {tuple(r) for r in permits.standing(runs, str(d(65)), str(d(70))).collect()} == {("a", d(60), d(70))}


def test_passes_in_batch_and_stream(spark, tmp_path):
    t0 = dt.datetime(2026, 3, 2, 8)
    rows = [("u", "s", t0 + dt.timedelta(minutes=m), float(m), a, v) for m, a, v in [(0, 5.0, 1.0), (4, 5.0, None), (5, 50.0, 1.0), (6, 5.0, 9.0), (30, 5.0, 1.0), (33, 5.0, 1.0)]]
    rows.append(("u", "z", t0 + dt.timedelta(hours=9), 0.0, 1.0, 1.0))
    ddl = "user string, street string, at timestamp, along double, accuracy_m double, speed_mps double"
    df = spark.createDataFrame(rows, ddl)
    want = {("s", 4.0), ("s", 3.0), ("z", 0.0)}
    assert {(r.street, r.cover) for r in fold.passes(df).collect()} == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = fold.passes(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("passes_out").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {(r.street, r.cover) for r in spark.table("passes_out").collect()} == want - {("z", 0.0)}  # still open at the watermark


def test_decayed_weights_are_the_closed_form(spark, tmp_path):
    t0 = dt.datetime(2026, 3, 2)
    rows = [(k, t0 + dt.timedelta(days=n)) for k, ns in (("a", (0, 1, 30)), ("b", (2,))) for n in ns]
    spark.createDataFrame(rows, "key string, at timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = fold.decayed_weights(spark.readStream.schema("key string, at timestamp").parquet(str(tmp_path / "in")))
    out.writeStream.format("memory").queryName("weights_out").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    got = {r.key: r.weight for r in spark.table("weights_out").collect()}
    assert abs(got["a"] - (2 ** -1 + 2 ** (-29 / 30) + 1)) < 1e-9 and got["b"] == 1


def test_headway_bands(spark):
    times = [28800, 29400, 30000, 30000, 30600, 36000, 37200, 38400, 50000]
    df = spark.createDataFrame([("l", 0, t) for t in times], "lane string, service int, dep int")
    got = [tuple(r)[2:] for r in transit.headway_bands(df, ["lane", "service"], "dep").orderBy("start").collect()]
    assert got == [(28800, 30600, 600), (36000, 38400, 1200), (50000, 50000, 0)]


def test_fuzzy_tokens_against_every_pair(spark):
    rnd = random.Random(2)
    words = ["".join(rnd.choices("abcd", k=rnd.randint(1, 8))) for _ in range(120)]
    queries = ["".join(rnd.choices("abcd", k=rnd.randint(3, 7))) for _ in range(25)]
    got = {(r.q, r.token): r.edits for r in search.fuzzy_tokens(spark.createDataFrame([(w,) for w in words], "token string"), spark.createDataFrame([(q,) for q in set(queries)], "q string"), 1).collect()}
    want = {(q, w): e for q in queries for w in words if (e := search.prefix_edit_distance(q, w, 1)) is not None}
    assert got == want
    assert search.prefix_edit_distance("braodway", "broadway") == 1 and search.prefix_edit_distance("brod", "broadway") == 1


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿Job Number,BIN,Street,Date\n1,7,"Main, ""Old""\nSt",2026-01-02\n2,,Elm,2026-01-02\n3,9,Oak,2026-01-01\n', encoding="utf-8")
    got = {r.job: (r.bin, r.street, r.day) for r in files.read_snapshots(spark, str(tmp_path / "a.csv")).collect()}
    assert got["1"] == ("7", 'Main, "Old"\nSt', "2026-01-02") and got["2"][0] is None and got["3"][2] == "2026-01-02"
    with zipfile.ZipFile(tmp_path / "feed.zip", "w") as z:
        z.writestr("inner/stops.txt", "stop_id,stop_name\nA,Alpha\nB,Bay\n")
    assert {r.row["stop_name"] for r in files.read_gtfs_table(spark, str(tmp_path / "feed.zip"), "stops").collect()} == {"Alpha", "Bay"}
    ring = [[0, 0], [1, 0], [1, 1]]
    (tmp_path / "f.json").write_text("\n".join(json.dumps({"id": i, "properties": {"h": "3"}, "geometry": {"type": t, "coordinates": c}}) for i, t, c in (("p", "Polygon", [ring]), ("m", "MultiPolygon", [[ring], [ring]]))))
    assert sorted(r.id for r in files.read_features(spark, str(tmp_path / "f.json")).collect()) == ["m", "m", "p"]
    p = spark.range(1).select(files.wkt_point(F.lit("POINT (-73.9 40.7)")).alias("p")).first().p
    assert (p.x, p.y) == (-73.9, 40.7)
    (tmp_path / "h.tsv").write_text("job\truns\na\t2026-01-01..2026-01-03,2026-02-01..\n")
    h = files.read_history(spark, str(tmp_path / "h.tsv"))
    files.write_history(h, str(tmp_path / "h2"))
    assert files.read_history(spark, str(tmp_path / "h2")).collect() == h.collect() and h.first().runs[1].last is None
    files.write_tiles(spark.range(10).selectExpr("id % 2 AS x", "id % 3 AS y", "id"), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("x = 1 AND y = 2").count() == 1


def test_publish_closes_the_open_record(spark):
    none = spark.createDataFrame([], "first date, last date, hash string")
    body = spark.range(5)
    one = files.publish(none, body, "2026-01-01")
    assert files.publish(one, body, "2026-02-01").count() == 1
    two = sorted(tuple(r)[:2] for r in files.publish(one, spark.range(6), "2026-02-01").collect())
    assert [str(x) for r in two for x in r] == ["2026-01-01", "2026-01-31", "2026-02-01", "None"]


def test_paged_source(spark, tmp_path):
    for o in (0, 4, 8):
        (tmp_path / f"{o}.json").write_text(json.dumps([{"id": str(i)} for i in range(o, min(o + 4, 10))]))
    spark.dataSource.register(PagedSource)
    df = spark.read.format("paged").option("path", str(tmp_path)).option("rows", 10).option("page", 4).load()
    assert df.rdd.getNumPartitions() == 3 and df.count() == 10
