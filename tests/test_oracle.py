"""Every registered query with a DuckDB counterpart must give the same rows on the smallest scale factor."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from checks import duckdb_queries, spark_queries, stored_queries
from checks.compare import difference, duck

SF = "/root/testdata/sf0.001"
SLOW = {"lear_models", "lear_forecast", "quantile_gbt", "quantile_forest", "contributions", "batch_forecast"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_is_registered_once():
    assert set(oracle_sql()) <= set(queries())
    assert set(spark_queries.QUERIES) - set(duckdb_queries.ORACLE) == SLOW
    assert set(stored_queries.QUERIES) == set(stored_queries.ORACLE)


def test_entry(spark):
    df = entry(spark)
    assert len(df.columns) == 37 and df.count() > 0


@pytest.mark.parametrize("name", sorted(duckdb_queries.ORACLE | stored_queries.ORACLE))
def test_same_rows_as_duckdb(spark, con, name):
    df = queries()[name](spark, SF)
    cur = con.execute(oracle_sql()[name])
    want = ([c[0] for c in cur.description], cur.fetchall())
    assert difference((df.columns, [tuple(r) for r in df.collect()]), want) is None
