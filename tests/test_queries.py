"""Every query with SQL gives the rows that DuckDB gives for it."""

from __future__ import annotations

import duckdb
import pytest
from compare import rows

from lumenkg.plans import own_queries, own_sql
from lumenkg.plans.bridge import BASE

SF = "/root/testdata/sf0.001"
QUERIES, SQL = own_queries(), own_sql()


@pytest.fixture(scope="module")
def duck():
    found = duckdb.connect()
    for t in BASE:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return found


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    asked = duck.execute(SQL[name])
    names = [d[0] for d in asked.description]
    assert sorted(found.columns) == sorted(names)
    assert rows(found.columns, found.collect()) == rows(names, asked.fetchall())


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - SQL.keys()))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
