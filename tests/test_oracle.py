"""The driver contract: every registered query with SQL agrees with DuckDB (sf0.001)."""

import duckdb
import pytest

import __spark_entry__ as E
from murmur.plans import catalog
from murmur.sources.tables import TABLES
from tools.check_oracle import rows_of

SF = "/root/testdata/sf0.001"
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "illiquidity" in df.columns


def test_every_query_has_sql_or_is_documented():
    rows_only = set(catalog.QUERIES) - set(catalog.ORACLE)
    assert rows_only <= {"model_predictions", "model_results"}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_duckdb(spark, con, name):
    df = E.queries()[name](spark, SF)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.sql(SQL[name])
    assert sorted(s_cols) == sorted(res.columns)
    d_rows = res.fetchall()
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(res.columns, d_rows)
