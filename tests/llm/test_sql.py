"""The llm queries with SQL against DuckDB."""

import os

import duckdb
import pytest

from engramite.llm import queries
from tests.test_oracles import TABLES, rows


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, sf, name):
    con = duckdb.connect()
    for table in TABLES:
        path = f"{sf}/{table}.parquet"
        con.sql(f"create view {table} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    assert rows(queries.QUERIES[name](spark, sf).toPandas()) == rows(con.sql(queries.ORACLES[name]).df())
