"""Every registered query against its SQL on the smallest tables."""

import datetime
import math
import os

import duckdb
import pytest

from seriesloom.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"create view {name.split('.')[0]} as select * from '{FOLDER}/{name}'")
    return con


def normal(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x.date() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, tables, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted((tuple(normal(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLE_SQL:
        assert found
        return
    sql = tables.sql(registry.ORACLE_SQL[name])
    at = [sql.columns.index(c) for c in sorted(sql.columns)]
    assert columns == sorted(sql.columns)
    assert found == sorted((tuple(normal(r[i]) for i in at) for r in sql.fetchall()), key=repr)
