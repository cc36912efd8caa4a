"""The commit log: a commit for every order date, from two writers in turn."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import Warehouse
from tidemark.session import scratch_path
from workload import query
from workload.roles import table

DAYS_SQL = """days AS (
  SELECT CAST(o_orderdate AS TIMESTAMP) AS day, count(*) AS orders, row_number() OVER (ORDER BY o_orderdate) AS seq
  FROM orders GROUP BY o_orderdate),
commits AS (
  SELECT seq, strftime(day, '%Y-%m-%d') AS batch_id, CASE WHEN seq % 2 = 1 THEN 'odd' ELSE 'even' END AS source,
         day AS watermark, orders AS rows_inserted FROM days)"""


def committed(spark: SparkSession, sf_dir: str) -> Warehouse:
    """The log as a reader finds it who comes to it afterwards."""
    base = scratch_path(spark, "warehouse")
    writers = {"odd": Warehouse(spark, base), "even": Warehouse(spark, base)}
    days = table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("timestamp_ntz").alias("day")).count()
    for k, row in enumerate(days.orderBy("day").collect()):
        source = ("odd", "even")[k % 2]
        batch = row["day"].strftime("%Y-%m-%d")
        writers[source].commit(batch, "orders", source, row["day"], row["count"], 0, row["day"], seen=max(0, k - 1))
    return Warehouse(spark, base)


@query("commit_log", f"WITH {DAYS_SQL} SELECT * FROM commits")
def commit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return committed(spark, sf_dir).commits().select("seq", "batch_id", "source", "watermark", "rows_inserted")


@query(
    "commit_marks",
    f"WITH {DAYS_SQL} SELECT source, max(watermark) AS last_watermark, max(watermark) AS last_run_time FROM commits GROUP BY source",
)
def commit_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return committed(spark, sf_dir).watermarks()


@query(
    "commits_visible",
    f"""WITH {DAYS_SQL}
SELECT batch_id, rows_inserted FROM commits WHERE seq > (SELECT max(seq) // 2 FROM commits)""",
)
def commits_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches that a reader still sees who came after the first half was cleared."""
    warehouse = committed(spark, sf_dir)
    half = warehouse.last_commit() // 2
    kept = [(r["batch_id"], r["rows_inserted"]) for r in warehouse.commits_of("orders") if r["seq"] > half]
    return spark.createDataFrame(kept, "batch_id string, rows_inserted bigint")
