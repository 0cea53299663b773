"""Every registered query with SQL gives the rows that the SQL gives, over the smallest tables."""

import datetime
import decimal
import glob
import os

import duckdb
import pytest

import mosaique.queries  # noqa: F401
from mosaique import registry


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        inside = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{inside}'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_matches_sql(spark, duck, sf_dir, name):
    df = registry.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    found = sorted((plain(tuple(r)) for r in df.select(*columns).collect()), key=repr)
    want = duck.sql(registry.ORACLES[name])
    assert columns == sorted(want.columns)
    assert found == sorted((plain(tuple(r)) for r in want.select(*[f'"{c}"' for c in columns]).fetchall()), key=repr)


def test_queries_without_sql_are_known():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry_module(spark, sf_dir):
    import __spark_entry__ as entry

    assert "similar_groups" in entry.queries() and "similar_groups" in entry.oracle_sql()
    assert entry.entry(spark).columns
