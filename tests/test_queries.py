"""Every query against its SQL on the smallest tables, as the driver does on larger ones."""

import glob
import math
import os
from decimal import Decimal

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = [n for n in entry.queries() if n != "pipeline" and not n.startswith("op")]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float | Decimal):
        return "nan" if math.isnan(v) else repr(round(float(v), 6))
    return str(v)


def table(columns, rows):
    order = sorted(columns)
    return order, sorted(tuple(plain(r[columns.index(c)]) for c in order) for r in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf, duck, name):
    df = entry.queries()[name](spark, sf)
    got = table(df.columns, df.collect())
    if sql := entry.oracle_sql().get(name):
        r = duck.execute(sql)
        assert got == table([d[0] for d in r.description], r.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
