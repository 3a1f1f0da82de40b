"""Every registered query with SQL gives the same rows as DuckDB over the same files."""

import datetime
import decimal
import glob
import os

import duckdb
import pandas as pd
import pytest

from strandline.plans import registry


def plain(value):
    if value is None or value is pd.NaT:
        return None
    if isinstance(value, float):
        return None if value != value else round(value, 5)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 5)
    if isinstance(value, (datetime.datetime, pd.Timestamp)):
        return pd.Timestamp(value).isoformat()
    return value


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return con


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, row)) for row in df.select(columns).collect()), key=str)
    assert len(set(columns)) == len(columns)
    if name in registry.ORACLE_SQL:
        result = duck.execute(registry.ORACLE_SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == columns
        order = sorted(range(len(names)), key=lambda i: names[i])
        assert got == sorted((tuple(plain(row[i]) for i in order) for row in result.fetchall()), key=str)
