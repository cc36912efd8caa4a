"""Batches as large as the table they go to: moved no more often than they must be."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import Contract, Field, contract_named, register_contract
from tidemark.operators import staging
from tidemark.operators.quality import duplicate_rows, most_alike
from tidemark.operators.scd2 import scd2_delta, scd2_first
from tidemark.operators.staging import batch_row_ordinal, with_position, write_staged
from tidemark.plans import Cube, Source, Warehouse, rebuild_stale
from tidemark.plans.job import refresh_batch
from workload import jobs

AT = datetime(2024, 3, 1)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_are_numbered_where_they_lie(spark, tmp_path):
    rows = with_position(write_staged(spark.range(0, 1000, 1, 3), path=str(tmp_path / "s")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = batch_row_ordinal(rows)
        assert "SortMergeJoin" not in plan_of(numbered)
        assert numbered.filter("_row <> id").count() == 0 and numbered.count() == 1000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_file_is_numbered_once_and_not_row_by_row(spark, tmp_path):
    rows = batch_row_ordinal(with_position(write_staged(spark.range(50), path=str(tmp_path / "s")))).select("id", "_row")
    assert "shiftright" not in rows._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("hot_rows", [2, 1000])
def test_repeated_rows_by_one_shuffle(spark, hot_rows):
    rows = spark.createDataFrame(
        [("a", 1, 0), ("b", 1, 1), ("a", 1, 2), (None, 1, 3), (None, 1, 4), ("a", 2, 5), ("a", 1, 6), (None, None, 7)],
        "k string, l int, _row long",
    )
    most = most_alike(rows, ["k", "l"])
    assert most == 3 and most_alike(rows.limit(0), ["k"]) == 0
    found = duplicate_rows(rows, ["k", "l"], hot_rows=hot_rows, most=most)
    assert sorted(r["_row"] for r in found.collect()) == [2, 4, 6]
    assert found.columns == rows.columns
    assert duplicate_rows(rows, ["_row"], most=1).collect() == []
    if hot_rows > most:
        assert "Join" not in plan_of(found)


def test_delta_of_a_whole_batch(spark):
    columns = "k string, v string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
    current = spark.sql(
        "SELECT CAST(id AS STRING) AS k, 'x' AS v, TIMESTAMP_NTZ'2024-01-01' AS valid_from, "
        "CAST(NULL AS TIMESTAMP_NTZ) AS valid_to, true AS is_current FROM range(20)"
    )
    incoming = spark.sql("SELECT CAST(id AS STRING) AS k, IF(id % 3 = 0, 'y', 'x') AS v FROM range(5, 30)")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = scd2_delta(current, incoming, ["k"], ["v"], AT, unique_keys=True)
        whole = scd2_delta(current, incoming, ["k"], ["v"], AT, unique_keys=True, cut=False)
        assert plan_of(cut).count("SortMergeJoin") == 2 and plan_of(whole).count("SortMergeJoin") == 1
        assert sorted(map(str, cut.collect())) == sorted(map(str, whole.collect()))
        none = spark.createDataFrame([], columns)
        first = scd2_first(none, incoming, AT)
        assert sorted(map(str, first.collect())) == sorted(
            map(str, scd2_delta(none, incoming, ["k"], ["v"], AT, unique_keys=True).collect())
        )
        assert "Join" not in plan_of(first)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batch_with_bad_and_repeated_rows_is_counted_by_rows(spark, tmp_path):
    rows = spark.createDataFrame(
        [("1", "1", "A", "2024-01-01"), ("1", "1", "B", "never"), ("", "2", "A", "never"), ("3", "1", "A", "2024-01-01")],
        "order_id string, line_no string, status string, valid_from string",
    )
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    run = refresh_batch(warehouse, "lines", jobs.LINE_SOURCE, rows.coalesce(1), "run", "bad", as_of=AT)
    assert run.status == "failed" and run.rows_processed == 4
    assert run.errors[0] == "Validation failed: 2 rows failed, 2 passed".replace("2 passed", "2 rows passed")
    issues = warehouse.errors().groupBy("_row").count().orderBy("_row").collect()
    assert [r["_row"] for r in issues] == [1, 2] and issues[0]["count"] == 2


def test_rejected_batch_writes_its_repeated_rows_once(spark, tmp_path, monkeypatch):
    written = []
    plain = staging.write_staged

    def noted(df, path=None, name="batch"):
        written.append(name)
        return plain(df, path, name)

    for module in ("tidemark.operators.staging", "tidemark.operators.quality", "tidemark.plans.job"):
        monkeypatch.setattr(f"{module}.write_staged", noted)
    rows = spark.range(30).select(
        (F.col("id") % 10).cast("string").alias("order_id"),
        F.lit("1").alias("line_no"),
        F.lit("A").alias("status"),
        F.lit("2024-01-01").alias("valid_from"),
    )
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    run = refresh_batch(warehouse, "lines", jobs.LINE_SOURCE, rows, "run", "again", as_of=AT)
    assert run.errors[0] == "Validation failed: 20 rows failed, 10 rows passed"
    assert warehouse.errors().count() == 20 and written == ["batch"]


def test_keys_that_share_a_hash_are_counted_apart(spark):
    rows = spark.createDataFrame([("a", None), (None, "a"), ("b", "c")], "k string, l string")
    assert rows.select(F.xxhash64("k", "l")).distinct().count() == 2
    assert most_alike(rows, ["k", "l"]) == 1
    again = rows.unionByName(rows.filter("k = 'b'")).unionByName(rows.filter("l = 'a'"))
    assert most_alike(again, ["k", "l"]) == 2
    zeros = spark.createDataFrame([(0.0,), (-0.0,), (float("nan"),), (1.0,)], "k double")
    assert most_alike(zeros, ["k"]) == 2


def test_unique_keys_are_counted_by_their_hashes(spark, monkeypatch):
    grouped = []
    rows = spark.range(100).select(F.col("id").cast("string").alias("k"), F.lit("1").alias("l"))
    plain = type(rows).groupBy

    def noted(df, *columns):
        grouped.append(columns)
        return plain(df, *columns)

    monkeypatch.setattr(type(rows), "groupBy", noted)
    assert most_alike(rows, ["k", "l"]) == 1
    assert [c for c in grouped if c] == [("h",)]


def lines_of(spark, warehouse, rows, batch_id):
    facts = spark.createDataFrame(rows, "order_id string, line_no string, quantity double")
    refresh_batch(warehouse, "lines", Source("shipped", "table", "shipment", {}), facts, "run", batch_id, as_of=AT)


@pytest.mark.parametrize("fold_parts", [2, 16])
def test_facts_of_single_keys_are_not_summed(spark, tmp_path, monkeypatch, fold_parts):
    monkeypatch.setattr("tidemark.plans.grains.FOLD_PARTS", fold_parts)
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    members = [(str(k), "1", "AB"[k % 2], "2024-01-01") for k in range(40)]
    lines = spark.createDataFrame(members, "order_id string, line_no string, status string, valid_from string")
    refresh_batch(warehouse, "lines", jobs.LINE_SOURCE, lines, "run", "lines", as_of=AT)
    cube = Cube("lines", (), "shipment", ("order_line",), ("quantity",), (), {"order_line": ("status",)})
    kept = tmp_path / "w" / "grains"
    loads = [
        [(str(k), "1", 0.25 + k) for k in range(30)] + [("unknown", "1", 2.0)],
        [(str(k % 2), "1", 1.5) for k in range(30)],
        [(str(k), "1", 3.0) for k in range(10, 40)],
    ]
    types = set()
    for number, load in enumerate(loads):
        lines_of(spark, warehouse, load, f"load-{number}")
        rebuild_stale(warehouse, [cube])
        assert kept.exists() == (number > 0)
        wanted = {}
        for key, _, quantity in [row for rows in loads[: number + 1] for row in rows]:
            status = None if key == "unknown" else "AB"[int(key) % 2]
            total, count = wanted.get(status, (0.0, 0))
            wanted[status] = (total + quantity, count + 1)
        built = warehouse.cube("lines")
        types.add(str(built.schema))
        found = built.filter("grouping_id = 0").collect()
        assert {r["status"]: (float(r["quantity"]), r["row_count"]) for r in found} == wanted
    assert len(types) == 1


def test_first_versions_stay_where_they_are_staged(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    rows = [("1", "n", "c", "2.5", "2024-01-03"), ("2", "n", "d", "3.5", "2024-01-07")]
    columns = "product_id string, product_name string, category string, price string, valid_from string"
    source = Source("products", "table", "product", {}, "valid_from")
    first = spark.createDataFrame(rows, columns)
    repeated = first.unionByName(first.limit(1))
    run = refresh_batch(warehouse, "c", source, repeated, "run", "bad", as_of=AT)
    assert run.status == "failed" and warehouse.dimension("product").count() == 0
    run = refresh_batch(warehouse, "c", source, first, "run", "one", as_of=AT)
    assert (run.rows_inserted, run.rows_updated, run.watermark) == (2, 0, datetime(2024, 1, 7))
    assert not (tmp_path / "w" / "stage").exists()
    moved = spark.createDataFrame([("2", "n", "e", "3.5", "2024-01-08"), ("3", "n", "e", "1", "2024-01-08")], columns)
    later = datetime(2024, 4, 1)
    run = refresh_batch(warehouse, "c", source, moved, "run", "two", as_of=later)
    assert (run.rows_inserted, run.rows_updated) == (2, 1)
    versions = warehouse.dimension("product").orderBy("product_id", "valid_from")
    assert versions.schema.names == contract_named("product").columns
    assert [(r["product_id"], r["category"], r["valid_from"], r["valid_to"], r["is_current"]) for r in versions.collect()] == [
        ("1", "c", AT, None, True),
        ("2", "d", AT, later, False),
        ("2", "e", later, None, True),
        ("3", "e", later, None, True),
    ]


def test_rules_on_validity_see_that_of_the_rows(spark, tmp_path):
    name = f"spell_{tmp_path.name}"
    fields = (Field("k", "key"), Field("v", "text"), *jobs.VERSIONED)
    register_contract(Contract(name, "dimension", fields, unique=("valid_from",), key=("k",), compare=("v",)))
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    rows = spark.createDataFrame([("1", "a", "2024-01-01"), ("2", "a", "2024-01-02")], "k string, v string, valid_from string")
    run = refresh_batch(warehouse, "c", Source("s", "table", name, {}, "valid_from"), rows, "run", "one", as_of=AT)
    assert run.status == "success" and run.watermark == datetime(2024, 1, 2)
    assert {r["valid_from"] for r in warehouse.current(name).collect()} == {AT}
