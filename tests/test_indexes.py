"""Key filters and file marks: what they let a read leave out, and that nothing is missed."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import day
from tidemark.contracts import SALES
from tidemark.operators.key_index import filter_size, key_filter, may_hold
from tidemark.plans import Warehouse
from tidemark.sources.manifest import FileMarks
from tidemark.sources.marks import incremental_filter, late_rows

SF_DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("keys", [["a"], ["a", "b"]])
def test_filters_miss_no_key_and_name_few_others(spark, keys):
    draw = random.Random(1)
    batches = {n: [(draw.choice([None, f"k{draw.randrange(10**9)}"]), draw.randrange(10**6)) for _ in range(500)] for n in range(20)}
    frames, sizes = [], set()
    for n, rows in batches.items():
        size = filter_size(len(rows) * (1 + n % 3))
        sizes.add(size)
        frames.append(key_filter(spark.createDataFrame(rows, "a string, b long"), keys, size).withColumn("batch", F.lit(n)))
    filters = frames[0]
    for f in frames[1:]:
        filters = filters.unionByName(f)
    filters = spark.createDataFrame(filters.collect(), filters.schema)
    some = [rows[7] for n, rows in batches.items() if n % 4 == 0 and rows[7][0]]
    asked = spark.createDataFrame(some, "a string, b long")
    found = {r[0] for r in may_hold(filters, asked, keys, sorted(sizes), "batch").collect()}
    assert found >= {n for n, rows in batches.items() if n % 4 == 0 and rows[7][0]} and len(found) < 12
    assert may_hold(filters, asked.limit(0), keys, sorted(sizes), "batch").collect() == []


def facts(spark, ids):
    rows = [(i, "P", "C", 1.0, 2.0, day(1), "North", None) for i in ids]
    return spark.createDataFrame(rows, SALES.schema)


def test_only_batches_that_may_hold_a_key_are_read(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path))
    assert warehouse.facts_holding(SALES, facts(spark, ["1"])).collect() == []
    for n in range(6):
        warehouse.append_facts(SALES, facts(spark, [f"{n}-{k}" for k in range(50)]), f"b{n}", None)
        warehouse.commit(f"b{n}", SALES.table, "s", day(1), 50, 0, day(1))
    found = warehouse.facts_holding(SALES, facts(spark, ["2-7", "4-1", "new"]))
    read = {f.split("_batch_id=")[1].split("/")[0] for f in found.inputFiles()}
    assert {"b2", "b4"} <= read and len(read) < 5
    again = len(warehouse.log.rows())
    assert warehouse.facts_holding(SALES, facts(spark, ["none"])).count() <= 100
    assert len(warehouse.log.rows()) == again  # filters are made once
    assert warehouse.stats().collect()[0]["row_count"] == 300


def test_only_files_past_the_mark_are_opened(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(k, start + timedelta(hours=k) if k % 50 else None) for k in range(2000)]
    frame = spark.createDataFrame(rows, "id long, at timestamp_ntz")
    path = str(tmp_path / "t")
    frame.repartitionByRange(10, "at").write.parquet(path)
    marks = FileMarks(spark, path, str(tmp_path / "m"), "at")
    mark = start + timedelta(hours=1500)
    past = marks.past(mark)
    assert sorted(r.id for r in past.collect()) == sorted(r.id for r in incremental_filter(frame, "at", mark).collect())
    assert len(past.inputFiles()) <= 4
    late = marks.late(start + timedelta(hours=300))
    assert late.count() == late_rows(frame, "at", start + timedelta(hours=300)).count() and len(late.inputFiles()) <= 3
    # A file of late rows and one past the mark come: both are found, and only they are read for their marks.
    spark.createDataFrame([(9000, start), (9001, mark + timedelta(days=99))], frame.schema).repartition(2).write.mode("append").parquet(path)
    before = spark.read.parquet(str(tmp_path / "m")).count()
    assert marks.past(mark).filter("id >= 9000").count() == 1 and marks.late(start).filter("id >= 9000").count() == 1
    assert spark.read.parquet(str(tmp_path / "m")).count() - before <= 2
    assert marks.high_water_mark().first()[0] == mark + timedelta(days=99)
    assert marks.past(None).count() == 2002 and marks.past(datetime(2030, 1, 1)).count() == 0
