"""Each query gives the rows of its SQL, at the smallest scale."""

import datetime
import decimal
import glob
import os

import pytest

from jsonloom import catalog


@pytest.fixture(scope="module")
def duck(sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return round(float(v), 6)
    return v.isoformat() if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_rows(spark, sf, duck, name):
    got = catalog.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    want = duck.sql(catalog.ORACLE[name])
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert rows == sorted(repr([plain(r[i]) for i in at]) for r in want.fetchall()) and rows


def test_entry():
    import __spark_entry__

    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", ["json_concat_reader", "json_sql_functions", "json_typed_values", "json_variant"])
def test_no_core_is_left_idle(spark, sf, name):
    """However few row groups the events have."""
    assert catalog.QUERIES[name](spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_table_functions_are_spread(spark, sf):
    """And the counts, a row an event, are joined without a broadcast."""
    plan = catalog.QUERIES["json_table_functions"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Broadcast" not in plan
