import duckdb
import pytest

from quillspark.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.queries()))
def test_runs(spark, small, name):
    df = llm.queries()[name](spark, small)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0 or name == "p2_limits"  # so few values pile up at no length


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows(spark, small, name):
    con = duckdb.connect()
    for t in ("aiscript", "documents", "size_limit"):
        con.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    got = llm.queries()[name](spark, small)
    want = con.sql(llm.oracle_sql()[name])
    at = [want.columns.index(c) for c in got.columns]
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r[i] for i in at) for r in want.fetchall())


def test_report_has_the_cases_found(spark, small):
    """Cases and report come from one verdict; the records without residue are those without a case."""
    found, report = llm.p2_found(spark, small).count(), llm.p2_report(spark, small).agg({"n_cut": "sum"}).first()[0]
    assert report == found > 0
    clean, cases = llm.p7_clean(spark, small), llm.p7_found(spark, small).select("rec_id").distinct()
    assert clean.join(cases, "rec_id").count() == 0 and clean.count() + cases.count() == spark.read.parquet(f"{small}/aiscript.parquet").count()
