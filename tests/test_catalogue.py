"""Every registered query against its SQL twin."""

import os

import duckdb
import pytest

from quaymark import catalogue

QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for f in os.listdir(data):
        con.sql(f"create view {f.split('.')[0]} as select * from '{data}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [list(rel.columns).index(c) for c in sorted(df.columns)]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(QUERIES) <= set(__spark_entry__.queries())
