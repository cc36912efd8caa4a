"""Mark, run log and invalidation queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.plans import Warehouse
from tidemark.session import scratch_path
from workload import query
from workload.roles import EVENT_RUNS_SQL, event_runs, table, when
from workload.extract import MARK, SINCE

MARKED = {"orders": "o_orderdate", "lineitem": "l_shipdate", "events": "ts"}


def _marks(spark, sf_dir, names, run_time, until=None):
    """Marks a run over the given tables would bring, reading rows up to ``until``."""
    frames = []
    for name in names:
        column = F.col(MARKED[name])
        rows = table(spark, sf_dir, name)
        if until is not None:
            rows = rows.filter(column <= F.lit(until.isoformat(sep=" ")).cast("timestamp_ntz"))
        frames.append(
            rows.agg(F.max(column).alias("last_watermark")).select(
                F.lit(name).alias("source"),
                "last_watermark",
                F.lit(run_time.isoformat(sep=" ")).cast("timestamp_ntz").alias("last_run_time"),
            )
        )
    return reduce(DataFrame.unionByName, frames)


MARKS_SQL = f"""
stored AS (
  SELECT 'orders' AS source, max(o_orderdate) AS last_watermark, {when(MARK)} AS last_run_time
  FROM orders WHERE o_orderdate <= {when(MARK)}
  UNION ALL
  SELECT 'lineitem', max(l_shipdate), {when(MARK)} FROM lineitem WHERE l_shipdate <= {when(MARK)}),
fresh AS (
  SELECT 'lineitem' AS source, max(l_shipdate) AS last_watermark, {when(SINCE)} AS last_run_time FROM lineitem
  UNION ALL SELECT 'events', max(ts), {when(SINCE)} FROM events),
marks AS (
  SELECT source, max(last_watermark) AS last_watermark, max(last_run_time) AS last_run_time
  FROM (SELECT * FROM stored UNION ALL SELECT * FROM fresh) GROUP BY source)
"""


def _merged_marks(spark, sf_dir):
    stored = _marks(spark, sf_dir, ["orders", "lineitem"], MARK, until=MARK)
    return state.watermark_upsert(stored, _marks(spark, sf_dir, ["lineitem", "events"], SINCE))


@query("watermark_upsert", f"WITH {MARKS_SQL} SELECT * FROM marks")
def upsert(spark, sf_dir):
    return _merged_marks(spark, sf_dir)


@query("watermark_get", f"WITH {MARKS_SQL} SELECT * FROM marks WHERE source = 'lineitem'")
def get(spark, sf_dir):
    return state.watermark_get(_merged_marks(spark, sf_dir), "lineitem")


@query(
    "run_duration",
    f"""WITH {EVENT_RUNS_SQL}
SELECT run_id, CAST(date_diff('microsecond', start_time, end_time) // 1000 AS BIGINT) AS duration_ms FROM runs""",
)
def duration(spark, sf_dir):
    return state.run_duration(event_runs(spark, sf_dir)).select("run_id", "duration_ms")


@query(
    "run_summary",
    f"""WITH {EVENT_RUNS_SQL}
SELECT count(*) AS total_runs, count(*) FILTER (status = 'success') AS successful,
       count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'partial') AS partial,
       CAST(sum(rows_processed) AS BIGINT) AS total_rows_processed,
       CAST(sum(rows_inserted) AS BIGINT) AS total_rows_inserted,
       CAST(sum(rows_updated) AS BIGINT) AS total_rows_updated
FROM runs""",
)
def summary(spark, sf_dir):
    return state.run_summary(event_runs(spark, sf_dir))


@query(
    "load_counts",
    f"""WITH {EVENT_RUNS_SQL}
SELECT source, CAST(sum(rows_processed) AS BIGINT) AS rows_processed,
       CAST(sum(rows_inserted) AS BIGINT) AS rows_inserted, CAST(sum(rows_updated) AS BIGINT) AS rows_updated
FROM runs GROUP BY source""",
)
def load_counts(spark, sf_dir):
    return state.load_counts(event_runs(spark, sf_dir))


@query(
    "latest_run",
    f"""WITH {EVENT_RUNS_SQL}
SELECT run_id, cube, source, start_time, end_time, rows_processed, rows_inserted, rows_updated, status
FROM (SELECT *, row_number() OVER (PARTITION BY cube, source ORDER BY end_time DESC, run_id DESC) AS n FROM runs)
WHERE n = 1""",
)
def latest(spark, sf_dir):
    return state.latest_run(event_runs(spark, sf_dir))


@query(
    "refresh_log_append",
    f"""WITH {EVENT_RUNS_SQL}
SELECT run_id, cube, source, status, end_time FROM runs""",
)
def log_append(spark, sf_dir):
    """Runs of before and after the middle of the month, appended to the log and read back."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    runs = event_runs(spark, sf_dir)
    middle = F.lit("2024-01-15").cast("timestamp_ntz")
    for part in (F.col("start_time") <= middle, F.col("start_time") > middle):
        warehouse.log_runs(runs.filter(part))
    return warehouse.runs().select("run_id", "cube", "source", "status", "end_time")


INVALIDATIONS_SQL = """
invalidations AS (SELECT CAST(user_id AS VARCHAR) AS cube, event_type AS reason, ts AS event_time FROM events
                  WHERE event_type = 'error'),
clears AS (SELECT CAST(user_id AS VARCHAR) AS cube, max(ts) AS cleared_at FROM events
           WHERE event_type = 'purchase' GROUP BY 1)
"""


@query(
    "invalidation_log",
    f"""WITH {INVALIDATIONS_SQL}
SELECT i.cube, i.reason, i.event_time FROM invalidations i LEFT JOIN clears c ON i.cube = c.cube
WHERE c.cleared_at IS NULL OR i.event_time > c.cleared_at""",
)
def open_invalidations(spark, sf_dir):
    """Errors invalidate a user's cube, a purchase clears what came before."""
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    events = table(spark, sf_dir, "events").withColumn("cube", F.col("user_id").cast("string"))
    raised = events.filter("event_type = 'error'").select(
        "cube", F.array("event_type").alias("sources"), F.col("event_type").alias("reason"), F.col("ts").alias("event_time")
    )
    warehouse.invalidate_all(raised)
    warehouse.clear_all(events.filter("event_type = 'purchase'").select("cube", F.col("ts").alias("cleared_at")))
    return warehouse.invalidations().select("cube", "reason", "event_time")


@query(
    "invalidations_of_cube",
    f"""WITH {EVENT_RUNS_SQL}
SELECT cube, source, end_time AS event_time FROM runs WHERE cube = 'purchase'""",
)
def of_cube(spark, sf_dir):
    warehouse = Warehouse(spark, scratch_path(spark, "warehouse"))
    runs = event_runs(spark, sf_dir)
    warehouse.invalidate_all(runs.select("cube", F.array("source").alias("sources"), F.col("end_time").alias("event_time")))
    found = warehouse.invalidations("purchase")
    return found.select("cube", F.col("sources")[0].alias("source"), "event_time")
