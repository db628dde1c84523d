"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from kinweave.plans import catalog


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return c


def plain(v):
    if v is None:
        return "~"
    if isinstance(v, float):
        return "~" if math.isnan(v) else f"{v:.6g}"
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_as_sql(spark, con, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.execute(catalog.SQL[name])
    theirs = [d[0] for d in rel.description]
    assert sorted(theirs) == cols
    at = [theirs.index(c) for c in cols]
    want = sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
    got = sorted(tuple(plain(v) for v in r) for r in df.select(*cols).collect())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
