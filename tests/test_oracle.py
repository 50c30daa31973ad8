"""Every registered query against its DuckDB reference SQL, on the sf0.001 tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as E
from liftwise.plans.catalog import CATALOG
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, bag


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(CATALOG))
def test_query_matches_oracle(spark, duck, name):
    sql = E.oracle_sql()
    assert name in sql
    df = E.queries()[name](spark, SF_SMALL)
    res = duck.execute(sql[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(d_cols)
    assert bag(df.columns, [tuple(r) for r in df.collect()]) == bag(d_cols, res.fetchall())


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "IR" in df.columns
