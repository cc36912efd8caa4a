"""The physical plans the operators are meant to get."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tests.fixtures import day
from tidemark.contracts import SALES
from tidemark.operators import scd2
from tidemark.operators.cubes import DimensionJoin, build_cube
from tidemark.operators.quality import check_rows
from tidemark.operators.staging import first_per_key, hot_keys, join_hot_apart
from tidemark.operators.upsert import absent_rows
from tidemark.plans import Warehouse
from workload.roles import order_feed

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def tables(spark, tmp_path):
    """A big table and a small batch, as files, so that their sizes are known."""
    big = spark.range(0, 200_000, 1, 4).select(
        F.col("id").alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("name"),
        F.lit("2024-01-01").cast("timestamp_ntz").alias("valid_from"),
        F.lit(None).cast("timestamp_ntz").alias("valid_to"),
        F.lit(True).alias("is_current"),
    )
    big.write.parquet(str(tmp_path / "big"))
    spark.range(0, 100).select(F.col("id").alias("k"), F.lit("x").alias("name")).write.parquet(str(tmp_path / "small"))
    return spark.read.parquet(str(tmp_path / "big")), spark.read.parquet(str(tmp_path / "small"))


def test_a_small_batch_leaves_a_big_dimension_in_place(spark, tables):
    """The big side meets a broadcast of the batch's keys; only what passes is moved."""
    dimension, batch = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200KB")
    try:
        delta = scd2.scd2_delta(dimension, batch, ["k"], ["name"], day(2), unique_keys=True)
        absent = absent_rows(dimension.select("k", "name"), batch, ["k"], [F.col("name")])
        plans = [plan_of(delta), plan_of(absent)]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    for plan in plans:
        semi = [line for line in plan.splitlines() if "LeftSemi" in line]
        assert semi and all("BroadcastHashJoin" in line for line in semi)


def test_merge_shuffles_each_side_once_without_broadcasts(spark, tables):
    dimension, batch = tables
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        current = dimension.filter("is_current")
        plan = plan_of(scd2.scd2_delta(current, batch, ["k"], ["name"], day(2), unique_keys=True))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") <= 3
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan


def test_first_row_per_key_is_cut_before_the_shuffle(spark, tables):
    plan = plan_of(first_per_key(tables[0], ["name"], [F.col("k")]))
    shuffle = plan.index("Exchange hashpartitioning")
    assert "Partial" in plan[shuffle:]


def test_cube_expands_sums_and_not_facts(spark, tables):
    big, small = tables
    dim = DimensionJoin(small.withColumnRenamed("name", "label"), "k", "k", ("label",))
    plan = plan_of(build_cube(big.select("k", "name"), [dim], ["label", "name"], ["k"]))
    expand = plan.index("Expand")
    assert "HashAggregate" in plan[expand:] and "Exchange" in plan[expand:]
    assert "ReadSchema: struct<k:bigint,name:string>" in plan


def test_row_rules_run_in_generated_code(spark):
    checked = check_rows(order_feed(spark, SF_DIR), SALES).drop("_issues")
    plan = checked._jdf.queryExecution().executedPlan()
    assert plan.toString().startswith("*(") or "*(1)" in plan.toString()


def test_rows_of_hot_keys_are_joined_apart(spark, tables):
    rows = tables[0].select((F.col("k") % 1000 * F.when(F.col("k") % 3 == 0, 0).otherwise(1)).alias("k"))
    lookup = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_keys(lookup, ["k"], "n", 50_000)
    assert [r["k"] for r in hot.collect()] == [0]
    joined = join_hot_apart(rows, lookup, ["k"], hot)
    plan = plan_of(joined)
    assert "BroadcastHashJoin" in plan and "Union" in plan
    assert joined.count() == 200_000
    assert hot_keys(lookup, ["k"], "n", 500_000) is None


def test_reads_prune_batches_and_push_filters(spark, tmp_path):
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    typed = spark.createDataFrame([("1", "P", "C", 1.0, 2.0, day(1), "North", None)], SALES.schema)
    for batch in ("a", "b"):
        warehouse.append_facts(SALES, typed, batch, "sale_date")
    warehouse.commit("b", SALES.table, "sales", day(1), 1, 0, day(2))
    found = warehouse.facts("sales", {"region": "North"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.inputFiles() and all("_batch_id=b" in f for f in found.inputFiles())
    assert "PushedFilters: [EqualNullSafe(region,North)]" in plan
    assert warehouse.facts("sales").count() == 1
