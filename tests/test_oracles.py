"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as driver
from fieldgauge.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return connection


def comparable(frame):
    def text(value):
        if value is None or pd.isna(value):
            return None
        if isinstance(value, str):
            return value
        return repr(float(value))

    frame = frame[sorted(frame.columns)].map(text)
    return sorted(map(tuple, frame.itertuples(index=False)), key=repr)


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_equals_sql(spark, duck, name):
    ours = driver.queries()[name](spark, SF).toPandas()
    theirs = duck.execute(driver.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert comparable(ours) == comparable(theirs)


def test_entry(spark):
    assert driver.entry(spark).count() > 0
