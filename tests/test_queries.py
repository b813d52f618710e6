"""Every registered query against its SQL, on the smallest tables."""

import math
import os

import duckdb
import pytest

from lacuna.plans import all_queries

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are missing")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def table(columns, rows):
    order = sorted(columns)
    return sorted(tuple(repr(plain(r[columns.index(c)])) for c in order) for r in rows)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sql, name):
    query = all_queries()[name]
    df = query.run(spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if query.sql is None:
        return
    result = sql.execute(query.sql)
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert table(df.columns, rows) == table(columns, result.fetchall())
