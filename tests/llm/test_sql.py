"""The queries with SQL give the rows that DuckDB gives."""

import os

import duckdb
import pytest

from lodeframe.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir):
    c = duckdb.connect()
    for view in ("documents", "benchmark", "pages"):
        path = f"{sf_dir}/{view}.parquet"
        c.sql(f"CREATE VIEW {view} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    df = queries.queries()[name](spark, sf_dir)
    columns = ", ".join(df.columns)
    key = lambda r: [(x is None, x) for x in r[:2]]
    assert sorted(map(tuple, df.collect()), key=key) == sorted(c.sql(f"SELECT {columns} FROM ({queries.ORACLE_SQL[name]})").fetchall(), key=key)
