"""The registered queries that SQL can express, against DuckDB on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as driver
from fieldgauge.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in "documents pages benchmark conversations".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def test_all_thirteen_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) <= set(driver.queries()) and set(queries.ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    ours = queries.QUERIES[name](spark, SF)
    columns = sorted(ours.columns)
    rows = sorted((tuple(r[c] for c in columns) for r in ours.collect()), key=repr)
    theirs = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert rows == sorted(theirs, key=repr)
