"""Every registered query against its SQL check, on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from sylvagrid import plans

SF = "/root/testdata/sf0.001"
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    yield con
    con.close()


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    clean = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in at) for r in rows]
    return sorted(names), sorted(clean, key=lambda r: tuple((x is None, str(type(x)), 0 if x is None else x) for x in r))


@pytest.mark.parametrize("key", sorted(plans.queries()))
def test_query(spark, duck, key):
    df = entry.queries()[key](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(key)
    if sql is None:
        assert rows
        return
    res = duck.execute(sql)
    want_names, want = ordered([d[0] for d in res.description], res.fetchall())
    names, got = ordered(df.columns, rows)
    assert names == want_names
    assert len(got) == len(want)
    for a, b in zip(got, want):
        for x, y in zip(a, b):
            if isinstance(x, float) and isinstance(y, float):
                assert x == pytest.approx(y, rel=1e-9, abs=2e-6)
            else:
                assert x == y


def test_entry_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["yr", "level", "clade", "genus", "total"]
    assert df.count() > 0
