"""Run state as tables: marks, refresh runs, invalidations."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.naming import matches
from tidemark.operators.staging import first_per_key

WATERMARKS = "source string, last_watermark timestamp_ntz, last_run_time timestamp_ntz"
RUNS = (
    "run_id string, cube string, source string, start_time timestamp_ntz, end_time timestamp_ntz, "
    "rows_processed bigint, rows_inserted bigint, rows_updated bigint, watermark timestamp_ntz, "
    "status string, errors array<string>"
)
INVALIDATIONS = "cube string, sources array<string>, event_time timestamp_ntz, reason string"


class Run(NamedTuple):
    """A run record, in the column order of ``RUNS``."""

    run_id: str
    cube: str
    source: str
    start_time: datetime
    end_time: datetime
    rows_processed: int
    rows_inserted: int
    rows_updated: int
    watermark: datetime | None
    status: str
    errors: list[str] | None


def watermark_get(watermarks: DataFrame, source: str) -> DataFrame:
    """The stored mark and run time of a source; no row for an unknown one."""
    return watermarks.filter(F.col("source") == source)


def watermark_upsert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Marks after a run: the later of old and new per source, other sources kept. A
    mark never moves back, so a backfill does not make later rows come again."""
    both = stored.unionByName(fresh)
    return both.groupBy("source").agg(
        F.max("last_watermark").alias("last_watermark"), F.max("last_run_time").alias("last_run_time")
    )


def run_duration(runs: DataFrame) -> DataFrame:
    """Runs with ``duration_ms``."""
    micros = F.timestamp_diff("MICROSECOND", F.col("start_time"), F.col("end_time"))
    return runs.withColumn("duration_ms", F.floor(micros / F.lit(1000)).cast("bigint"))


def run_summary(runs: DataFrame) -> DataFrame:
    """One row of totals over the runs given."""
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        *[F.count_if(F.col("status") == s).alias(n) for s, n in _STATUS_COLUMNS],
        *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias("total_" + c) for c in _ROW_COLUMNS],
    )


_STATUS_COLUMNS = (("success", "successful"), ("failed", "failed"), ("partial", "partial"))
_ROW_COLUMNS = ("rows_processed", "rows_inserted", "rows_updated")


def load_counts(runs: DataFrame) -> DataFrame:
    """Rows processed, inserted and updated per source."""
    return runs.groupBy("source").agg(*[F.sum(c).alias(c) for c in _ROW_COLUMNS])


def latest_run(runs: DataFrame) -> DataFrame:
    """The last run of every cube and source."""
    return first_per_key(runs, ["cube", "source"], [F.col("end_time").desc(), F.col("run_id").desc()])


def invalidations_of(events: DataFrame, cube: str | None = None) -> DataFrame:
    return events if cube is None else events.filter(F.col("cube") == cube)


def without_cleared(events: DataFrame, clears: DataFrame) -> DataFrame:
    """Events that no clear mark covers. A mark (``cube``, ``cleared_at``) covers the events
    of its cube up to its time."""
    latest = clears.groupBy(F.col("cube").alias("_l_cube")).agg(F.max("cleared_at").alias("_cleared_at"))
    marked = events.join(latest, matches(["cube"], "_l_"), "left")
    open_event = F.col("_cleared_at").isNull() | (F.col("event_time") > F.col("_cleared_at"))
    return marked.filter(open_event).select(*events.columns)
