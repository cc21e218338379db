"""Every query runs; those with SQL give DuckDB's rows."""

import glob
import os

import pytest

from erspark import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(repr, df.astype(object).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(queries.Q))
def test_query(spark, con, name):
    got = rows(queries.Q[name](spark, SF).toPandas())
    if name in queries.SQL:
        assert got == rows(con.execute(queries.SQL[name]).df())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["s1_id", "cand_id"]
    assert set(e.oracle_sql()) <= set(e.queries())
