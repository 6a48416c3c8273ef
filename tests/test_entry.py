"""Registered queries: their names, and results against SQL on the smallest tables."""

import glob
import os

import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck(sf_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def test_names_and_flagship(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", CORE)
def test_query_equals_sql(spark, sf_dir, duck, name):
    got = entry.queries()[name](spark, sf_dir).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.sql(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)

    def clean(df):
        cell = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
        return sorted(repr([cell(x) for x in r]) for r in df[columns].astype(object).itertuples(index=False))

    assert clean(got) == clean(want)
