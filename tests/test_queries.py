"""Every registered query against its SQL, over whole tables of the smallest size."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as driver
import workload

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels"
    " conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    yield connection
    connection.close()


def comparable(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return str(value) if value is not None else None


def bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(comparable(row[i]) for i in order) for row in rows)


@pytest.mark.parametrize("name", sorted(workload.QUERIES))
def test_query(spark, duck, name):
    result = driver.queries()[name](spark, SF_DIR)
    rows = [tuple(r) for r in result.collect()]
    assert rows, "a query over whole tables has rows"
    plan = result._jdf.queryExecution().executedPlan().toString()
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan
    sql = driver.oracle_sql().get(name)
    if sql is None:
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(result.columns)
    expected, found = bag(columns, cursor.fetchall()), bag(result.columns, rows)
    assert found == expected, (list((found - expected).items())[:3], list((expected - found).items())[:3])


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def test_every_expected_result_has_its_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())
