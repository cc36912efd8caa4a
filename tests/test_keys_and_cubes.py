"""Composite keys, cubes across calls, stream starts, time zones and batch order."""

from __future__ import annotations

import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tests.fixtures import SALES, SALES_HEADER, SALES_INVALID, SALES_LATER, day, write_csv
from tidemark.contracts import REGISTRY, Contract, Field, register_contract
from tidemark.operators.scd2 import as_of_join
from tidemark.operators.staging import batch_row_ordinal, with_position, write_staged
from tidemark.operators.upsert import table_scan_eq
from tidemark.plans import Cube, Job, Source, Warehouse, rebuild_stale, refresh
from tidemark.plans import job as jobs
from tidemark.plans.job import refresh_batch, stage_batch
from tidemark.sources import read_source
from tidemark.sources import json as json_source
from tidemark.sources.json import json_path_rows, json_records
from tidemark.streaming import raw_stream, refresh_stream

VISIT = Contract("visit", "fact", (Field("a", "key"), Field("b", "key"), Field("fee", "number")))
ROOM = Contract(
    "room",
    "dimension",
    (Field("a", "key"), Field("b", "key"), Field("size", "text"), Field("valid_from", "date"),
     Field("valid_to", "date", optional=True), Field("is_current", "flag", default=True)),
    key=("a", "b"),
    compare=("size",),
)
ROOMS = Source("rooms", "table", "room", {})


@pytest.fixture()
def warehouse(spark, tmp_path):
    kept = dict(REGISTRY)
    register_contract(VISIT)
    register_contract(ROOM)
    yield Warehouse(spark, str(tmp_path / "warehouse"))
    REGISTRY.clear()
    REGISTRY.update(kept)


def rooms(spark, *rows):
    return spark.createDataFrame([(*r, "2024-01-01") for r in rows], "a string, b string, size string, valid_from string")


def load(warehouse, source, frame, name, at=1):
    return refresh_batch(warehouse, "c", source, frame, "run", name, as_of=day(at))


def test_repeated_composite_keys_never_reach_a_dimension(spark, warehouse):
    first = rooms(spark, ("x", "1", "S"), ("x", "2", "M"), ("y", "1", "L"))
    assert load(warehouse, ROOMS, first, "b1").rows_inserted == 3
    twice = load(warehouse, ROOMS, rooms(spark, ("x", "1", "T"), ("x", "1", "U"), ("y", "1", "L")), "b2", 2)
    assert twice.status == "failed" and warehouse.dimension("room").count() == 3
    assert [(r["field"], r["value"]) for r in warehouse.errors().collect()] == [("a, b", "x, 1")]
    changed = rooms(spark, ("x", "1", "T"), ("y", "1", "L"))
    for name, at, expected in (("b3", 3, (1, 1)), ("b4", 4, (0, 0))):
        run = load(warehouse, ROOMS, changed, name, at)
        assert (run.rows_inserted, run.rows_updated) == expected
    assert warehouse.current("room").groupBy("a", "b").count().filter("count > 1").isEmpty()
    assert warehouse.dimension("room").count() == 4


def test_cube_over_a_composite_key(spark, warehouse):
    load(warehouse, ROOMS, rooms(spark, ("x", "1", "S"), ("x", "2", "M")), "b1")
    visits = spark.createDataFrame([("x", "2", 10.0)], "a string, b string, fee double")
    load(warehouse, Source("visits", "table", "visit", {}), visits, "v1")
    cube = Cube("c", (), "visit", ("room",), ("fee",), (), {"room": ("size",)})
    assert rebuild_stale(warehouse, [cube]) == ["c"]
    rows = {(r["size"], float(r["fee"]), r["row_count"]) for r in warehouse.cube("c").collect()}
    assert rows == {("M", 10.0, 1), (None, 10.0, 1)}
    with pytest.raises(ValueError, match="lack part of the key"):
        jobs.rebuild_cube(warehouse, Cube("d", (), "sales", ("room",), ("amount",)))


def sales_job(tmp_path, rows=SALES):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, rows)
    cubes = tuple(Cube(n, ("s",), measures=("amount",)) for n in ("a", "b"))
    return Job((Source("s", "csv", "sales", {"path": path}, "sale_date"),), cubes)


def total(warehouse, cube):
    return warehouse.cube(cube).filter("grouping_id = 1").first()["row_count"]


def test_cubes_of_one_source_in_two_calls(warehouse, tmp_path):
    job = sales_job(tmp_path)
    refresh(warehouse, job, "a")
    assert warehouse.cube("b") is None and warehouse.is_stale("b", job.cubes[1].tables)
    refresh(warehouse, job, "b")
    assert total(warehouse, "a") == total(warehouse, "b") == 10
    refresh(warehouse, sales_job(tmp_path, SALES + SALES_LATER), "b")
    assert (total(warehouse, "a"), total(warehouse, "b")) == (10, 13)
    assert rebuild_stale(warehouse, job.cubes) == ["a"] and total(warehouse, "a") == 13


def test_a_rebuild_that_fails_stops_no_other_and_is_made_up_for(warehouse, tmp_path, monkeypatch):
    job, build = sales_job(tmp_path), jobs.rebuild_cube

    def broken(warehouse, cube):
        if cube.name == "a":
            raise RuntimeError("no space")
        build(warehouse, cube)

    with monkeypatch.context() as lost:
        lost.setattr(jobs, "rebuild_cube", broken)
        runs = {(r["cube"], r["source"]): r for r in refresh(warehouse, job).collect()}
    assert runs["a", jobs.REBUILD]["status"] == "failed" and "no space" in runs["a", jobs.REBUILD]["errors"][0]
    assert warehouse.cube("a") is None and total(warehouse, "b") == 10
    refresh(warehouse, job)  # brings no row
    assert total(warehouse, "a") == 10


def stream(spark, warehouse, folder):
    files = raw_stream(spark, str(folder / "in"), SALES_HEADER.split(","), files_per_batch=1)
    source = Source("sales", "csv", "sales", {}, "sale_date")
    refresh_stream(warehouse, Cube("sales", ("sales",), measures=("amount",)), source, files, str(folder / "checkpoint"))


def land(folder, name, rows):
    (folder / "in").mkdir(exist_ok=True)
    write_csv(folder / "in" / name, SALES_HEADER, rows)
    time.sleep(1.1)  # the stream takes files by their time


def test_small_micro_batches_take_no_row_for_late(spark, warehouse, tmp_path):
    land(tmp_path, "1.csv", SALES[7:])
    land(tmp_path, "2.csv", SALES_INVALID)
    land(tmp_path, "3.csv", SALES[:3])
    with pytest.raises(Exception, match="Validation failed"):
        stream(spark, warehouse, tmp_path)
    write_csv(tmp_path / "in" / "2.csv", SALES_HEADER, SALES[3:7])
    stream(spark, warehouse, tmp_path)  # goes on with the mark of the start that was lost
    assert warehouse.facts("sales").count() == 10
    land(tmp_path, "4.csv", [*SALES[-2:], *SALES_LATER])
    stream(spark, warehouse, tmp_path)
    assert warehouse.facts("sales").count() == 13
    assert sorted(r["id"] for r in warehouse.late("sales").collect()) == ["s-09", "s-10"]
    assert "2 late rows" in warehouse.runs().orderBy(F.desc("start_time")).first()["errors"][0]


@pytest.fixture()
def elsewhere(monkeypatch):
    monkeypatch.setenv("TZ", "America/New_York")
    time.tzset()
    yield
    monkeypatch.undo()
    time.tzset()


def test_moments_are_utc_wherever_the_driver_is(spark, warehouse, elsewhere):
    frame = spark.sql("SELECT TIMESTAMP_NTZ '2024-01-05 12:00:00' AS at, 'x' AS k UNION ALL SELECT NULL, 'y'")
    assert [r["k"] for r in table_scan_eq(frame, {"at": datetime(2024, 1, 5, 12)}).collect()] == ["x"]
    assert [r["k"] for r in table_scan_eq(frame, {"at": None}).collect()] == ["y"]
    warehouse.invalidate("c", ["s"], day(5, hour=10), "before")
    warehouse.clear_invalidations(day(5, hour=11))
    warehouse.invalidate("c", ["s"], day(5, hour=12), "after")
    assert warehouse.invalidations().select("reason").collect() == [("after",)]


def test_positions_of_many_files_from_one_task(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "1")
    try:
        staged = with_position(write_staged(spark.range(1100).coalesce(1), path=str(tmp_path / "s")))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    rows = batch_row_ordinal(staged).orderBy("_row").select("id", "_row", "_pos").collect()
    assert [(r["id"], r["_row"]) for r in rows] == [(k, k) for k in range(1100)]
    assert len({r["_pos"] for r in rows}) == 1100


def test_a_named_order_holds_across_files(spark, tmp_path):
    from tidemark.contracts import SALES as CONTRACT

    (tmp_path / "in").mkdir()
    write_csv(tmp_path / "in" / "a.csv", SALES_HEADER, SALES[:1])
    write_csv(tmp_path / "in" / "b.csv", SALES_HEADER, [*SALES[1:], SALES[0]])
    raw = read_source(spark, "csv", {"path": str(tmp_path / "in")}, CONTRACT)
    staged = stage_batch(raw, CONTRACT, "sale_date", str(tmp_path / "s"), ("sale_date", "id"))
    rows = batch_row_ordinal(staged).orderBy("_row").select("id").collect()
    assert [r["id"] for r in rows] == sorted(["s-01", *[r.split(",")[0] for r in SALES]])


def test_large_bodies_fail_and_landed_arrays_do_not(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(json_source, "LARGE_BODY", 100)
    records = ", ".join(f'{{"id": {k}, "name": "n{k}"}}' for k in range(500))
    (tmp_path / "a.json").write_text(f"[{records}]")
    body = spark.createDataFrame([("[" + records,)], "body string")
    with pytest.raises(Exception, match="too large"):
        json_path_rows(body, "body", None, ["id"]).collect()
    assert json_records(spark, str(tmp_path / "a.json"), ["id", "name"], lines=False).count() == 500


@pytest.mark.parametrize("long_history", [1, 1000])
def test_both_as_of_plans_agree(spark, tmp_path, long_history):
    spark.sql(
        "SELECT id % 5 AS a, id % 3 AS b, TIMESTAMP_NTZ '2024-01-01' + make_dt_interval(id % 40) AS at FROM range(2000)"
    ).write.parquet(str(tmp_path / "f"))
    versions = spark.sql(
        "SELECT id % 5 AS a, CAST(id / 5 AS INT) % 3 AS b, CAST(id / 15 AS INT) AS label,"
        " TIMESTAMP_NTZ '2024-01-05' + make_dt_interval(CAST(id / 15 AS INT) * 7) AS valid_from,"
        " TIMESTAMP_NTZ '2024-01-05' + make_dt_interval(CAST(id / 15 AS INT) * 7 + 5) AS valid_to FROM range(45)"
    )
    facts = spark.read.parquet(str(tmp_path / "f"))
    joined = as_of_join(facts, versions, ("a", "b"), "at", ["label"], long_history=long_history)
    days = F.datediff("at", F.lit("2024-01-05"))
    label = F.when((days >= 0) & (days % 7 < 5) & (days < 21), F.floor(days / 7))
    assert joined.filter(~label.eqNullSafe(F.col("label"))).count() == 0 and joined.count() == 2000
    plan = joined._jdf.queryExecution().executedPlan().toString()
    if long_history > 1:
        assert plan.count("FileScan parquet") == 1 and "BroadcastHashJoin" in plan
