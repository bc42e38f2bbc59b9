"""Every query with SQL gives what DuckDB gives on the same tables."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from engramite.plans import library

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(value):
    if hasattr(value, "tolist") and not isinstance(value, (str, bytes)):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(tuple(plain(x) for x in r) for r in frame[names].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.sql(f"create view {name} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


@pytest.mark.parametrize("name", sorted(library.QUERIES))
def test_matches_sql(spark, duck, sf, name):
    got = rows(library.QUERIES[name](spark, sf).toPandas())
    if name in library.ORACLES:
        assert got == rows(duck.sql(library.ORACLES[name]).df())
    else:
        assert got[1]
