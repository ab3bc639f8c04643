"""Every core query that has SQL gives the same rows in DuckDB."""

import glob
import os
from collections import Counter

import duckdb
import pytest

from quillspark.plans import queries as core


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if hasattr(v, "asDict"):
        return tuple((k, plain(x)) for k, x in v.asDict().items())
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in v.items())
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_same_rows(spark, small, duck, name):
    df = core.queries()[name](spark, small)
    columns = sorted(df.columns)
    got = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    want = duck.sql(core.oracle_sql()[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert got == Counter(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.queries()) - set(core.oracle_sql())))
def test_runs(spark, small, name):
    assert core.queries()[name](spark, small).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
