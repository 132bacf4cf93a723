"""Every query that has SQL gives the SQL's rows on the smallest driver tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LLM = ("op", "pipeline")
NAMES = sorted(n for n in entry.queries() if not n.startswith(LLM))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for file in os.listdir(DATA):
        c.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(columns).collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert name == ""  # every query has its SQL
        return
    found = duck.execute(sql)
    names = [x[0] for x in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert rows == sorted(repr(tuple(r[i] for i in at)) for r in found.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 1
