from __future__ import annotations

from tests.fixtures import day
from tidemark.operators import state


def runs(spark):
    rows = [
        ("r1", "sales", "csv", day(1), day(1, hour=1), 10, 10, 0, day(24), "success", None),
        ("r2", "sales", "csv", day(2), day(2, hour=2), 3, 0, 0, None, "failed", ["bad"]),
        ("r2", "sales", "db", day(2), day(2, hour=1), 5, 2, 1, None, "success", None),
    ]
    return spark.createDataFrame(rows, state.RUNS)


def test_latest_run_per_cube_and_source(spark):
    latest = {r["source"]: r["run_id"] for r in state.latest_run(runs(spark)).collect()}
    assert latest == {"csv": "r2", "db": "r2"}


def test_summary_counts_and_duration(spark):
    frame = runs(spark)
    assert state.run_summary(frame).first().asDict() == {
        "total_runs": 3,
        "successful": 2,
        "failed": 1,
        "partial": 0,
        "total_rows_processed": 18,
        "total_rows_inserted": 12,
        "total_rows_updated": 1,
    }
    assert state.run_summary(frame.limit(0)).first()["total_rows_processed"] == 0
    assert {r["duration_ms"] for r in state.run_duration(frame).collect()} == {3_600_000, 7_200_000}
    assert sorted(state.load_counts(frame).collect()) == [("csv", 13, 10, 0), ("db", 5, 2, 1)]


def test_marks_move_forward_only(spark):
    stored = spark.createDataFrame([("a", day(10), day(11)), ("b", day(5), day(6))], state.WATERMARKS)
    fresh = spark.createDataFrame([("a", day(8), day(20)), ("c", day(1), day(20))], state.WATERMARKS)
    merged = {r["source"]: (r["last_watermark"], r["last_run_time"]) for r in state.watermark_upsert(stored, fresh).collect()}
    assert merged == {"a": (day(10), day(20)), "b": (day(5), day(6)), "c": (day(1), day(20))}
    assert state.watermark_get(stored, "nope").count() == 0


def test_cleared_invalidations(spark):
    events = spark.createDataFrame(
        [("s", ["x"], day(1), "r"), ("s", ["x"], day(3), "r"), ("t", ["y"], day(1), "r")], state.INVALIDATIONS
    )
    clears = spark.createDataFrame([("s", day(2)), ("s", day(1))], "cube string, cleared_at timestamp_ntz")
    left = state.without_cleared(events, clears)
    assert sorted((r["cube"], r["event_time"]) for r in left.collect()) == [("s", day(3)), ("t", day(1))]
    assert state.invalidations_of(left, "t").count() == 1
    assert state.invalidations_of(left).count() == 2
