"""``spark-submit … tidemark run``: one refresh from a JSON configuration."""

from __future__ import annotations

import argparse
import json
import sys
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.state import run_duration, run_summary
from tidemark.plans import Warehouse, job_from_config, refresh


def parse_since(text: str | None) -> datetime | None:
    try:
        return datetime.fromisoformat(text) if text else None
    except ValueError:
        raise ValueError(f"--since takes an ISO date such as 2024-01-01T00:00:00Z, not {text!r}") from None


def show(runs: DataFrame) -> bool:
    """Print the run records, one JSON line per source; tells whether all succeeded."""
    rows = run_duration(runs).orderBy("start_time").collect()
    for run in rows:
        print(json.dumps(run.asDict(), default=str))
    return all(run["status"] != "failed" for run in rows)


def main(arguments: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tidemark")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("run", help="refresh one cube or all of them")
    run.add_argument("--cube")
    run.add_argument("--since", help="process data since this date (ISO format)")
    run.add_argument("--config", default="./job.json")
    run.add_argument("--warehouse", required=True, help="base folder of the tables, shared by all executors")
    given = parser.parse_args(arguments)
    try:
        since = parse_since(given.since)
        job = job_from_config(json.loads(Path(given.config).read_text()))
        job.cubes_named(given.cube)
        spark = SparkSession.builder.appName("tidemark").config("spark.sql.session.timeZone", "UTC").getOrCreate()
        warehouse = Warehouse(spark, given.warehouse)
        runs = refresh(warehouse, job, given.cube, since)
        succeeded = show(runs)
        print(json.dumps({"summary": run_summary(runs).first().asDict()}))
        print(json.dumps({"tables": {r["table_name"]: r["row_count"] for r in warehouse.stats().collect()}}))
    except Exception as error:  # noqa: BLE001 - a command reports and sets its exit code
        print(f"refresh failed: {error}", file=sys.stderr)
        return 1
    return 0 if succeeded else 1


if __name__ == "__main__":
    sys.exit(main())
