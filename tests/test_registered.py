"""Every registered query against its SQL text on the smallest scale."""

import duckdb
import pytest

import __spark_entry__ as registered
from tools_compare import TABLES, rows

SF = "/root/testdata/sf0.001"
QUERIES = registered.queries()
ORACLES = registered.oracle_sql()


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    got = rows(df.columns, df.collect())
    if name not in ORACLES:
        assert got
        return
    cursor = db.execute(ORACLES[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert got == rows(names, cursor.fetchall())


def test_entry(spark):
    assert registered.entry(spark).count() > 0
