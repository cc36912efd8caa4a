from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tests.fixtures import day, write_csv
from tidemark.contracts import SALES, Contract, Field
from tidemark.sources import (
    batch_high_water_mark,
    csv_malformed,
    csv_scan,
    effective_mark,
    incremental_filter,
    json_pages,
    json_path_rows,
    late_rows,
    order_by_watermark,
    read_source,
    register_source,
)
from tidemark.sources.rest import request_headers, rest_pages, url_since
from tidemark.sources.jdbc import JdbcSplit, jdbc_options


def test_csv_rows_are_text(spark, tmp_path):
    path = write_csv(tmp_path / "a.csv", "id,name,value,date", ["a,Birch,12,2024-02-03", "b,Maple,7,2024-02-04"])
    rows = csv_scan(spark, path).collect()
    assert len(rows) == 2
    assert rows[0].asDict() == {"id": "a", "name": "Birch", "value": "12", "date": "2024-02-03", "_corrupt": None}


def test_csv_quotes_empty_cells_and_blank_lines(spark, tmp_path):
    path = write_csv(tmp_path / "q.csv", "id,name", ['1,"a ""quoted"", name"', "", "2,"])
    rows = [(r["id"], r["name"]) for r in csv_scan(spark, path).collect()]
    assert rows == [("1", 'a "quoted", name'), ("2", "")]


def test_csv_delimiter_and_missing_header(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1;x\n2;y\n")
    raw = csv_scan(spark, str(tmp_path / "n.csv"), delimiter=";", has_header=False, columns=["id", "name"])
    assert [(r["id"], r["name"]) for r in raw.collect()] == [("1", "x"), ("2", "y")]
    with pytest.raises(ValueError, match="column names"):
        csv_scan(spark, str(tmp_path / "n.csv"), has_header=False)


def test_ragged_records_are_found_whatever_columns_are_read(spark, tmp_path):
    path = write_csv(tmp_path / "r.csv", "a,b,c", ["1,2,3", "1,2", "1,2,3,4"])
    bad = csv_malformed(csv_scan(spark, path))
    assert [r["_corrupt"] for r in bad.select("a", "_corrupt").collect()] == ["1,2", "1,2,3,4"]
    assert csv_scan(spark, path).agg(F.count("_corrupt"), F.max("a")).first() == (2, "1")


def test_files_with_another_header_order_are_refused(spark, tmp_path):
    write_csv(tmp_path / "a.csv", "id,name", ["1,x"])
    write_csv(tmp_path / "b.csv", "name,id", ["y,2"])
    with pytest.raises(Exception, match="(?i)header"):
        csv_scan(spark, str(tmp_path)).collect()


def test_watermark_filter(spark, tmp_path):
    path = write_csv(
        tmp_path / "w.csv", "id,name,date", ["1,Larch,2024-01-03", "2,Pine,2024-01-14", "3,Rowan,2024-01-22", "4,Alder,?"]
    )
    raw = csv_scan(spark, path)
    fresh = incremental_filter(raw, "date", day(10))
    assert [r["id"] for r in fresh.collect()] == ["2", "3"]
    assert batch_high_water_mark(fresh, "date").first()[0] == day(22)
    assert [r["id"] for r in late_rows(raw, "date", day(15)).collect()] == ["1", "2"]
    assert incremental_filter(raw, "date", day(15)).count() == 1
    assert incremental_filter(raw, "date", None).count() == 4
    assert incremental_filter(raw, None, day(1)).count() == 4
    assert [r["id"] for r in order_by_watermark(fresh, "date").collect()] == ["2", "3"]
    assert batch_high_water_mark(raw.filter("id = '4'"), "date").first()[0] is None


def test_aware_marks_are_taken_to_utc(spark, tmp_path):
    path = write_csv(tmp_path / "z.csv", "id,date", ["1,2024-01-10T09:30:00Z", "2,2024-01-10T10:30:00Z"])
    mark = datetime(2024, 1, 10, 12, tzinfo=timezone(timedelta(hours=2)))
    assert [r["id"] for r in incremental_filter(csv_scan(spark, path), "date", mark).collect()] == ["2"]


@pytest.mark.parametrize("dtype", ["timestamp_ntz", "timestamp", "date"])
def test_mark_reaches_the_parquet_scan(spark, tmp_path, dtype):
    path = str(tmp_path / "t")
    at = F.date_add(F.lit("2024-01-01"), F.col("id").cast("int")).cast(dtype)
    spark.range(10).select("id", at.alias("at")).write.parquet(path)
    stored = spark.read.parquet(path)
    fresh = incremental_filter(stored, "at", day(5))
    assert "PushedFilters: [IsNotNull(at), GreaterThan(at" in fresh._jdf.queryExecution().toString()
    assert (fresh.count(), late_rows(stored, "at", day(5)).count()) == (5, 5)
    assert incremental_filter(stored, "at", day(5, hour=12)).count() == 5
    assert batch_high_water_mark(fresh, "at").first()[0] == day(10)


def test_since_wins_over_the_stored_mark():
    assert effective_mark(day(1), day(9)) == day(1)
    assert effective_mark(None, day(9)) == day(9)
    assert effective_mark(None, None) is None


@pytest.mark.parametrize(
    ("path", "body", "expected"),
    [
        ("data.orders", {"data": {"orders": [{"id": 1}, {"id": "b"}]}}, ["1", "b"]),
        ("data.orders", {"data": {"orders": {"id": 3}}}, ["3"]),
        ("data.orders", {"data": {"orders": []}}, []),
        ("data.orders", {"data": {"orders": None}}, [None]),
        ("data.orders", {"data": {}}, []),
        ("data.orders", {"data": 5}, []),
        ("data.1.orders", {"data": [{}, {"orders": [{"id": 7}]}]}, ["7"]),
        ("data.1", {"data": {"1": {"id": 8}}}, ["8"]),
        (None, [{"id": 1}, {"id": 2}], ["1", "2"]),
        (None, {"id": 4}, ["4"]),
    ],
)
def test_json_paths(spark, path, body, expected):
    frame = spark.createDataFrame([(json.dumps(body),)], "body string")
    assert [r["id"] for r in json_path_rows(frame, "body", path, ["id"]).collect()] == expected


def test_json_nested_values_stay_text(spark):
    frame = spark.createDataFrame([('{"a": [1, 2.50, {"b": true}]}',)], "body string")
    values = [r["v"] for r in json_path_rows(frame, "body", "a", value_column="v").collect()]
    assert values[0] == "1" and float(values[1]) == 2.5 and json.loads(values[2]) == {"b": True}


def test_landed_pages_and_a_broken_one(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"data": [\n {"id": 1, "amount": 5.5},\n {"id": 2}\n]}')
    (tmp_path / "2.json").write_text("<html>busy</html>")
    pages = json_pages(spark, str(tmp_path))
    assert json_path_rows(pages, "body", "data", ["id"]).count() == 2
    raw = read_source(spark, "json", {"path": str(tmp_path), "data_path": "data"}, SALES)
    assert sorted(r["_corrupt"] for r in raw.filter("_corrupt IS NOT NULL").collect()) == ["<html>busy</html>"]
    amounts = raw.filter("_corrupt IS NULL").select(F.try_variant_get("amount", "$", "double"))
    assert {r[0] for r in amounts.collect()} == {5.5, None}


def test_jdbc_options():
    split = JdbcSplit("id", 1, 1_000_000, 64)
    options = jdbc_options("jdbc:x", table="sales", split=split, user="u")
    assert options == {
        "url": "jdbc:x",
        "dbtable": "sales",
        "fetchsize": "10000",
        "user": "u",
        "partitionColumn": "id",
        "lowerBound": "1",
        "upperBound": "1000000",
        "numPartitions": "64",
    }
    grouped = jdbc_options("jdbc:x", table="sales", query="SELECT a FROM t WHERE b GROUP BY a")
    assert grouped["dbtable"] == "(SELECT a FROM t WHERE b GROUP BY a) AS q"
    with pytest.raises(ValueError, match="table or a query"):
        jdbc_options("jdbc:x")
    with pytest.raises(ValueError, match="at least one"):
        JdbcSplit("id", 0, 1, 0).options()


def test_custom_and_unknown_kinds(spark):
    contract = Contract("numbers", "fact", (Field("id", "key"),))

    @register_source("numbers")
    def numbers(session, options, *_):
        return session.range(options["n"])

    assert read_source(spark, "numbers", {"n": 3}, contract).count() == 3
    with pytest.raises(ValueError, match="no reader"):
        read_source(spark, "smoke signals", {}, contract)


def test_request_headers():
    assert request_headers() == {"Content-Type": "application/json"}
    assert request_headers({"Accept": "x"}, {"type": "bearer", "token": "t"})["Authorization"] == "Bearer t"
    basic = request_headers(None, {"type": "basic", "username": "u", "password": "p"})
    assert basic["Authorization"] == "Basic dTpw"
    assert "Authorization" not in request_headers(None, {"type": "basic", "username": "u"})


def test_mark_as_a_query_parameter():
    assert url_since("https://x.test/a", "sale_date", day(20)) == "https://x.test/a?sale_date=2024-01-20T00%3A00%3A00.000Z"
    later = url_since("https://x.test/a?page=1", "at", datetime(2024, 1, 20, 2, tzinfo=timezone(timedelta(hours=2))))
    assert later == "https://x.test/a?page=1&at=2024-01-20T00%3A00%3A00.000Z"


def test_responses_are_fetched_by_tasks(spark, tmp_path):
    for number in (1, 2):
        (tmp_path / f"{number}.json").write_text(json.dumps({"data": [{"id": number}, {"id": number * 10}]}))
    urls = [f"file://{tmp_path}/{n}.json" for n in (1, 2)]
    assert rest_pages(spark, urls).rdd.getNumPartitions() == 2
    raw = read_source(spark, "rest", {"urls": urls, "data_path": "data"}, SALES)
    assert sorted(r[0] for r in raw.select(F.try_variant_get("id", "$", "int")).collect()) == [1, 2, 10, 20]
    with pytest.raises(Exception, match="(?i)no such file|urlopen"):
        rest_pages(spark, [f"file://{tmp_path}/3.json"]).collect()
