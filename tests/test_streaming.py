from __future__ import annotations

import json

import pytest

from tests.fixtures import SALES, SALES_HEADER, SALES_INVALID, SALES_LATER, day, write_csv
from tidemark.plans import Cube, Source, Warehouse, rebuild_stale
from tidemark.contracts import SALES as CONTRACT
from tidemark.streaming import json_stream, raw_stream, refresh_stream

CUBE = Cube("sales", ("sales",), measures=("quantity", "amount"))
SOURCE = Source("sales", "csv", "sales", {}, "sale_date")


@pytest.fixture()
def folders(tmp_path):
    (tmp_path / "in").mkdir()
    return tmp_path


def run(spark, folders, **options):
    warehouse = Warehouse(spark, str(folders / "warehouse"))
    stream = raw_stream(spark, str(folders / "in"), SALES_HEADER.split(","), **options)
    query = refresh_stream(warehouse, CUBE, SOURCE, stream, str(folders / "checkpoint"), as_of=day(1, 2))
    query.awaitTermination()
    return warehouse


def test_new_files_are_loaded_once(spark, folders):
    write_csv(folders / "in" / "1.csv", SALES_HEADER, SALES)
    assert run(spark, folders).facts("sales").count() == 10
    assert run(spark, folders).facts("sales").count() == 10
    write_csv(folders / "in" / "2.csv", SALES_HEADER, [*SALES[-2:], *SALES_LATER])
    warehouse = run(spark, folders)
    assert warehouse.facts("sales").count() == 13
    assert warehouse.watermark("sales") == day(30)
    assert [r["rows_processed"] for r in warehouse.runs().orderBy("start_time").collect()] == [10, 3]
    assert warehouse.cube("sales") is None
    assert rebuild_stale(warehouse, [CUBE]) == ["sales"]
    assert warehouse.cube("sales").filter("region IS NULL").first()["row_count"] == 13
    assert rebuild_stale(warehouse, [CUBE]) == []


def test_a_failed_batch_blocks_until_it_is_fixed(spark, folders):
    bad = folders / "in" / "1.csv"
    write_csv(bad, SALES_HEADER, SALES_INVALID)
    with pytest.raises(Exception, match="Validation failed"):
        run(spark, folders)
    write_csv(folders / "in" / "2.csv", SALES_HEADER, SALES_LATER)
    with pytest.raises(Exception, match="Validation failed"):
        run(spark, folders)
    warehouse = Warehouse(spark, str(folders / "warehouse"))
    assert warehouse.facts("sales").count() == 0
    write_csv(bad, SALES_HEADER, SALES)
    assert run(spark, folders).facts("sales").count() == 13


def test_a_batch_that_is_run_again_changes_nothing(spark, folders):
    """The query is lost after its batch was committed, before the checkpoint says so."""
    write_csv(folders / "in" / "1.csv", SALES_HEADER, SALES)
    run(spark, folders)
    for name in ("0", ".0.crc"):
        (folders / "checkpoint" / "commits" / name).unlink(missing_ok=True)
    warehouse = run(spark, folders)
    assert warehouse.facts("sales").count() == 10
    assert warehouse.runs().count() == 1


def test_a_new_checkpoint_starts_anew_behind_the_mark(spark, folders):
    write_csv(folders / "in" / "1.csv", SALES_HEADER, SALES)
    warehouse = run(spark, folders)
    write_csv(folders / "in" / "2.csv", SALES_HEADER, SALES_LATER)
    stream = raw_stream(spark, str(folders / "in"), SALES_HEADER.split(","))
    refresh_stream(warehouse, CUBE, SOURCE, stream, str(folders / "other-checkpoint")).awaitTermination()
    assert warehouse.facts("sales").count() == 13
    assert sorted(r["rows_processed"] for r in warehouse.runs().collect()) == [3, 10]


def test_landed_responses_as_a_stream(spark, folders):
    names = SALES_HEADER.split(",")
    for number, rows in enumerate((SALES, SALES_LATER)):
        records = [dict(zip(names, row.split(","), strict=True)) for row in rows]
        (folders / "in" / f"{number}.json").write_text(json.dumps({"data": records}, indent=1))
    warehouse = Warehouse(spark, str(folders / "warehouse"))
    stream = json_stream(spark, str(folders / "in"), CONTRACT.columns, "data")
    refresh_stream(warehouse, CUBE, SOURCE, stream, str(folders / "checkpoint")).awaitTermination()
    assert warehouse.facts("sales").count() == 13
    (folders / "in" / "2.json").write_text("not json")
    again = json_stream(spark, str(folders / "in"), CONTRACT.columns, "data")
    with pytest.raises(Exception, match="malformed"):
        refresh_stream(warehouse, CUBE, SOURCE, again, str(folders / "checkpoint")).awaitTermination()
    assert warehouse.runs().filter("status = 'failed'").count() == 1
    assert warehouse.errors().first()["value"] == "not json"
