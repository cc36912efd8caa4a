"""Customers' priorities as versions, into which the fulfilled orders come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.backdated import CHANGED, backdated_versions, scd2_backdated
from workload import query
from workload.roles import table

BACKDATED_SQL = """stored AS (
  SELECT o_custkey, max(o_orderpriority) AS priority, CAST(o_orderdate AS TIMESTAMP) AS valid_from
  FROM orders WHERE o_orderstatus <> 'F' GROUP BY ALL),
late AS (
  SELECT o_custkey, max(o_orderpriority) AS priority, CAST(o_orderdate AS TIMESTAMP) AS valid_from
  FROM orders WHERE o_orderstatus = 'F' AND o_custkey % 3 <> 0 GROUP BY ALL),
line AS (
  SELECT *, false AS is_late, false AS replacing FROM stored s
  WHERE NOT EXISTS (SELECT 1 FROM late l WHERE l.o_custkey = s.o_custkey AND l.valid_from = s.valid_from)
  UNION ALL SELECT *, true, EXISTS (SELECT 1 FROM stored s WHERE l.o_custkey = s.o_custkey AND l.valid_from = s.valid_from)
  FROM late l),
told AS (
  SELECT *, lag(priority) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS before FROM line),
first AS (SELECT o_custkey, min(valid_from) AS since FROM stored GROUP BY o_custkey),
kept AS (
  SELECT t.* FROM told t LEFT JOIN first f USING (o_custkey)
  WHERE NOT (is_late AND NOT replacing AND coalesce(before = priority, false) AND coalesce(f.since < t.valid_from, false))),
versions AS (
  SELECT o_custkey, priority, valid_from, lead(valid_from) OVER (PARTITION BY o_custkey ORDER BY valid_from) AS valid_to, is_late
  FROM kept)"""
COLUMNS = ["o_custkey", "priority", "valid_from", "valid_to", "is_current"]


def _starts(spark: SparkSession, sf_dir: str, condition: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter(condition)
    start = F.col("o_orderdate").cast("timestamp_ntz").alias("valid_from")
    return orders.groupBy("o_custkey", start).agg(F.max("o_orderpriority").alias("priority"))


def _dimension(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    stored = _starts(spark, sf_dir, "o_orderstatus <> 'F'")
    end = F.lead("valid_from").over(Window.partitionBy("o_custkey").orderBy("valid_from"))
    dimension = stored.withColumn("valid_to", end).withColumn("is_current", F.col("valid_to").isNull()).select(*COLUMNS)
    return dimension, _starts(spark, sf_dir, "o_orderstatus = 'F' AND o_custkey % 3 <> 0")


@query(
    "scd2_backdated",
    f"WITH {BACKDATED_SQL} SELECT o_custkey, priority, valid_from, valid_to, valid_to IS NULL AS is_current FROM versions",
)
def backdated(spark: SparkSession, sf_dir: str) -> DataFrame:
    dimension, late = _dimension(spark, sf_dir)
    return scd2_backdated(dimension, late, ["o_custkey"], ["priority"])


@query(
    "scd2_backdated_starts",
    f"WITH {BACKDATED_SQL} SELECT o_custkey, priority, valid_from, valid_to FROM versions WHERE is_late",
)
def starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions that the late rows started."""
    dimension, late = _dimension(spark, sf_dir)
    added = backdated_versions(dimension, late, ["o_custkey"], ["priority"]).filter(F.col("_op") == CHANGED)
    return added.join(late.select("o_custkey", "valid_from"), ["o_custkey", "valid_from"], "left_semi").select(
        "o_custkey", "priority", "valid_from", "valid_to"
    )
