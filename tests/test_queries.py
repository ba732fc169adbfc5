"""Every registered query with SQL against DuckDB on the smallest tables; the others run."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from quern.plans.all import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return None if math.isnan(value) else round(float(value), 6)
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    return value


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, FOLDER)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    if name not in ORACLES:
        assert got
        return
    result = duck.sql(ORACLES[name])
    assert sorted(result.columns) == columns
    places = [result.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[p]) for p in places) for r in result.fetchall()), key=repr)
