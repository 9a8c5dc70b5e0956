"""Every query with SQL is held against DuckDB on the smallest tables; the others must run."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from sessionloom import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
entry._modules()


def plain(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, (bool, str)) or type(v).__name__ == "bool_":
        return str(v)
    return round(float(v), 6) if not hasattr(v, "__len__") else str(list(v))


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(v) for v in row]) for row in frame.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    if name not in registry.ORACLES:
        assert len(got) > 0
        return
    expected = duck.sql(registry.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert rows(got) == rows(expected)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
