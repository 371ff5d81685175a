"""Every query of the catalogue that has SQL gives the SQL's rows."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from quire.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    want = con.sql(catalogue.oracle_sql()[name])
    got = catalogue.queries()[name](spark, DATA)
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted([repr(tuple(map(plain, r))) for r in got.select(*want.columns).collect()])
    assert rows == sorted(repr(tuple(map(plain, r))) for r in want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200
    assert {*entry.oracle_sql()} <= {*entry.queries()}
