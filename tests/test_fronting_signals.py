"""Every block that passes the gate is listed, however many there are."""

import duckdb

from strider.plans import statistics


def test_more_than_twenty_blocks_pass(spark, tmp_path):
    # 30 blocks of 5 lots; blocks 0 to 24 pass, 25 to 27 are too high, 28 and 29 not commercial enough.
    lots = [(b * 5 + i, b, i) for b in range(30) for i in range(5)]
    part = [(b, f"Brand#{b:02}", 26 if 25 <= b < 28 else 25) for b in range(30)]
    line = [(o, b, "N" if i < (3 if b >= 28 else b % 3) else "R") for o, b, i in lots]
    orders = [(o, f"{1 + i % 2}-URGENT") for o, _, i in lots]
    con = duckdb.connect()
    for name, rows, schema in (
        ("part", part, "p_partkey long, p_brand string, p_size int"),
        ("lineitem", line, "l_orderkey long, l_partkey long, l_returnflag string"),
        ("orders", orders, "o_orderkey long, o_orderpriority string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got = [tuple(r) for r in statistics.fronting_signals(spark, str(tmp_path)).collect()]
    assert len(got) == 25
    assert got == con.execute(statistics.ORACLES["fronting_signals"]).fetchall()
