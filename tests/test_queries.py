"""Every registered query against its SQL, at the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as entry
from strider import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_matches_its_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted([plain(v) for v in r] for r in df.select(columns).collect())
    if name not in registry.oracles():
        return
    want = duck.execute(registry.oracles()[name])
    at = [[d[0] for d in want.description].index(c) for c in columns]
    assert got == sorted([plain(r[i]) for i in at] for r in want.fetchall())


def test_entry_is_the_flagship(spark):
    assert entry.entry(spark).columns == ["block", "lots", "share", "height", "flags"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
