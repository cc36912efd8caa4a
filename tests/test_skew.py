"""A third of the rows on one key, with broadcasts off and thresholds scaled down: the
joins that bring rows to their key's entry have to split that key over several tasks."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.operators.cubes import DimensionJoin, star_join
from tidemark.operators.quality import duplicate_rows, validate_gate
from tidemark.operators.scd2 import as_of_join
from tidemark.operators.staging import first_per_key, hot_keys, join_hot_apart

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}
ROWS, KEYS = 300_000, 5000


@pytest.fixture()
def facts(spark, tmp_path):
    """Facts of one day; member 0 has a third of them."""
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    member = F.when(F.col("id") % 3 == 0, F.lit(0)).otherwise(F.col("id") % KEYS)
    at = F.timestamp_add("SECOND", (F.col("id") % 80_000).cast("int"), F.lit("2024-01-05").cast("timestamp"))
    pad = F.sha2(F.col("id").cast("string"), 256).alias("pad")
    frame = spark.range(0, ROWS, 1, 8).select("id", member.alias("k"), at.cast("timestamp_ntz").alias("at"), pad)
    frame.write.parquet(str(tmp_path / "facts"))
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    yield spark.read.parquet(str(tmp_path / "facts"))
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df, tmp_path, name):
    df.write.parquet(str(tmp_path / name))
    return df.sparkSession.read.parquet(str(tmp_path / name))


def run(df, *columns):
    """Result of counting columns, and the plan it ended up with."""
    result = df.agg(F.count(F.lit(1)), *[F.count(c) for c in columns], F.count(F.xxhash64("pad")))
    counts = result.collect()[0]
    return tuple(counts)[:-1], result._jdf.queryExecution().executedPlan().toString()


def members(spark):
    return spark.range(KEYS).select(F.col("id").alias("member"), (F.col("id") % 7).alias("grp"))


def test_star_join(spark, facts, tmp_path):
    dim = DimensionJoin(stored(members(spark), tmp_path, "d"), "k", "member", ("grp",))
    counts, plan = run(star_join(facts, [dim]), "grp")
    assert counts == (ROWS, ROWS)
    assert "skew=true" in plan


def test_as_of_join(spark, facts, tmp_path):
    start = F.lit("2024-01-01").cast("timestamp_ntz")
    change = F.lit("2024-01-05 10:00:00").cast("timestamp_ntz")
    old = members(spark).select("member", "grp", start.alias("valid_from"), change.alias("valid_to"))
    new = members(spark).select(
        "member", (F.col("grp") + 100).alias("grp"), change.alias("valid_from"), F.lit(None).cast("timestamp_ntz").alias("valid_to")
    )
    versions = stored(old.unionByName(new), tmp_path, "v")
    joined = as_of_join(facts, versions, "k", "at", ["grp"], dimension_key="member")
    counts, plan = run(joined, F.when(F.col("grp") >= 100, 1))
    assert counts == (ROWS, facts.filter(F.col("at") >= change).count())
    assert "skew=true" in plan


@pytest.mark.parametrize("hot_rows", [ROWS // 10, ROWS * 10])
def test_duplicates(spark, facts, hot_rows):
    again = duplicate_rows(facts, ["k"], row="id", hot_rows=hot_rows)
    counts, plan = run(again)
    assert counts == (ROWS - facts.select("k").distinct().count(),)
    assert "skew=true" in plan or plan.count("BroadcastHashJoin") >= 2


@pytest.mark.parametrize("keys", [["k"], ["k", "grp"]])
def test_hot_rows_are_dealt_out(spark, facts, keys):
    """With adaptive execution off no task gets more than its share of the hot key; missing keys are keys."""
    rows = facts.select("id", F.when(F.col("k") != 0, F.col("k")).alias("k"), F.lit("g").alias("grp"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        again = duplicate_rows(rows, keys, row="id", hot_rows=ROWS // 60)
        per_task = [r[1] for r in again.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == ROWS - rows.select("k").distinct().count()
        assert max(per_task) < ROWS // 5
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_equal_rows_are_dealt_out(spark, facts):
    rows = facts.select(F.when(F.col("k") != 0, F.col("k")).alias("k"))
    counted = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = join_hot_apart(rows, counted, ["k"], hot_keys(counted, ["k"], "n", ROWS // 60), "left")
        per_task = [r[1] for r in joined.filter("k is null").groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == rows.filter("k is null").count() and max(per_task) < ROWS // 6
        assert joined.filter("n is null").isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_gate(spark, facts):
    errors = facts.filter("id = 5").select("k")
    kept, plan = run(validate_gate(facts, errors, by="k"))
    assert kept == (facts.filter("k <> 5").count(),)
    assert "skew=true" in plan


def test_cleared_invalidations(spark, facts, tmp_path):
    events = facts.select(F.col("k").alias("cube"), F.col("at").alias("event_time"), "pad")
    noon = F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")
    clears = stored(members(spark).select(F.col("member").alias("cube"), noon.alias("cleared_at")), tmp_path, "c")
    left, plan = run(state.without_cleared(events, clears))
    assert left == (facts.filter(F.col("at") > noon).count(),)
    assert "skew=true" in plan


def test_first_rows_need_no_whole_group(spark, facts):
    first = first_per_key(facts, ["k"], [F.col("id")])
    assert first.count() == facts.select("k").distinct().count()
    shuffled = first._jdf.queryExecution().executedPlan().toString()
    assert shuffled.rindex("WindowGroupLimit") > shuffled.index("Exchange")
