"""Every registered query against its SQL, on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

from lodeworks import registry

DATA = "/root/testdata/sf0.001"
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows(names, order, found):
    return sorted((tuple(plain(r[names.index(c)]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    ours = registry.queries()[name](spark, DATA)
    theirs = duck.sql(SQL[name])
    order = sorted(ours.columns)
    assert order == sorted(theirs.columns)
    assert rows(ours.columns, order, ours.collect()) == rows(theirs.columns, order, theirs.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
