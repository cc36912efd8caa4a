from __future__ import annotations

import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.fixtures import (
    CUSTOMERS,
    CUSTOMERS_HEADER,
    PRODUCTS,
    PRODUCTS_HEADER,
    SALES,
    SALES_HEADER,
    SALES_INVALID,
    SALES_LATER,
    day,
    write_csv,
)
from tidemark.plans.job import utc_now
from tidemark.plans import Cube, Job, Source, Warehouse, job_from_config, refresh


def sales_source(path, **options):
    return Source("sales_csv", "csv", "sales", {"path": path}, "sale_date", **options)


def star_job(folder, sales=SALES, products=PRODUCTS, customers=CUSTOMERS):
    return Job(
        (
            sales_source(write_csv(folder / "sales.csv", SALES_HEADER, sales)),
            Source(
                "products_csv",
                "csv",
                "product",
                {"path": write_csv(folder / "products.csv", PRODUCTS_HEADER, products)},
                "valid_from",
            ),
            Source(
                "customers_csv",
                "csv",
                "customer",
                {"path": write_csv(folder / "customers.csv", CUSTOMERS_HEADER, customers)},
                "valid_from",
            ),
        ),
        (
            Cube(
                "sales",
                ("sales_csv", "products_csv", "customers_csv"),
                dimensions=("product", "customer"),
                measures=("quantity", "amount"),
            ),
        ),
    )


def sales_job(path, **options):
    return Job((sales_source(path, **options),), (Cube("sales", ("sales_csv",), measures=("quantity", "amount")),))


@pytest.fixture()
def warehouse(spark, tmp_path):
    return Warehouse(spark, str(tmp_path / "warehouse"))


def by_source(runs):
    return {r["source"]: r for r in runs.collect()}


def test_full_load_and_incremental_file(warehouse, tmp_path):
    runs = by_source(refresh(warehouse, star_job(tmp_path), "sales", as_of=day(1, 2)))
    assert {s: (r["status"], r["rows_processed"], r["rows_inserted"]) for s, r in runs.items()} == {
        "sales_csv": ("success", 10, 10),
        "products_csv": ("success", 3, 3),
        "customers_csv": ("success", 5, 5),
    }
    assert runs["sales_csv"]["watermark"] == day(25)
    assert warehouse.watermark("sales_csv") == day(25)
    assert warehouse.current("product").filter("is_current").count() == 3

    later = star_job(tmp_path, sales=SALES + SALES_LATER)
    runs = by_source(refresh(warehouse, later, as_of=day(2, 2)))
    assert (runs["sales_csv"]["rows_processed"], runs["products_csv"]["rows_processed"]) == (3, 0)
    assert runs["products_csv"]["status"] == "success"
    assert warehouse.watermark("sales_csv") == day(30)
    assert warehouse.facts("sales").count() == 13

    cube = warehouse.cube("sales").filter("category IS NULL AND segment IS NULL")
    sums = {r["region"]: (int(r["quantity"]), float(r["amount"])) for r in cube.collect()}
    assert sums == {
        "Coast": (11, 217.20),
        "Hills": (6, 97.50),
        "Valley": (23, 469.50),
        "Delta": (13, 214.50),
        None: (53, 998.70),
    }
    stats = {r["table_name"]: r["row_count"] for r in warehouse.stats().collect()}
    assert stats == {"fact_sales": 13, "dim_product": 3, "dim_customer": 5}


def test_invalid_batch_loads_nothing(warehouse, tmp_path):
    path = write_csv(tmp_path / "bad.csv", SALES_HEADER, SALES_INVALID)
    run = refresh(warehouse, sales_job(path)).first()
    assert (run["status"], run["rows_processed"], run["rows_inserted"]) == ("failed", 4, 0)
    assert run["errors"][0] == "Validation failed: 3 rows failed, 1 rows passed"
    assert run["errors"][1] == "  Row 1:\n    - customer_id: Required field is missing or empty (value: \"\")"
    assert run["errors"][2] == "  Row 2:\n    - quantity: Number must be greater than 0 (value: -6)"
    assert warehouse.facts("sales").count() == 0
    assert warehouse.watermark("sales_csv") is None
    assert warehouse.invalidations().count() == 0
    found = {(r["_row"], r["field"], r["message"]) for r in warehouse.errors().collect()}
    assert found == {
        (1, "customer_id", "Required field is missing or empty"),
        (2, "quantity", "Number must be greater than 0"),
        (3, "sale_date", "Invalid date"),
        (3, "product_id", "Required field is missing or empty"),
    }


def test_duplicate_ids_fail_the_batch(warehouse, tmp_path):
    path = write_csv(tmp_path / "twice.csv", SALES_HEADER, [SALES[0], SALES[1], SALES[0]])
    run = refresh(warehouse, sales_job(path)).first()
    assert run["status"] == "failed"
    assert [(r["_row"], r["message"]) for r in warehouse.errors().collect()] == [(2, "Duplicate value found")]


def test_malformed_file_fails_its_source_only(warehouse, tmp_path):
    job = star_job(tmp_path, sales=[*SALES, "s-11,oak,ada"])
    runs = by_source(refresh(warehouse, job))
    assert runs["sales_csv"]["status"] == "failed"
    assert "malformed" in runs["sales_csv"]["errors"][0]
    kept = [(r["_row"], r["message"], r["value"]) for r in warehouse.errors().collect()]
    assert kept == [(10, "Malformed record", "s-11,oak,ada")]
    assert runs["products_csv"]["status"] == runs["customers_csv"]["status"] == "success"
    event = warehouse.invalidations("sales").first()
    assert event["sources"] == ["products_csv", "customers_csv"]


def test_a_malformed_record_is_found_behind_the_mark(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
    refresh(warehouse, sales_job(path))
    write_csv(tmp_path / "s.csv", SALES_HEADER, [*SALES, "s-00,oak,ada,1,1.00,2024-01-01", *SALES_LATER])
    run = refresh(warehouse, sales_job(path)).filter("status = 'failed'").first()
    assert "1 malformed" in run["errors"][0]
    assert warehouse.facts("sales").count() == 10


def test_missing_file_fails_its_source_only(warehouse, tmp_path):
    run = refresh(warehouse, sales_job(str(tmp_path / "nowhere.csv"))).first()
    assert run["status"] == "failed" and run["errors"]


def test_since_replaces_the_mark(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
    run = refresh(warehouse, sales_job(path), since=day(17)).first()
    assert run["rows_processed"] == 3
    assert sorted(r["id"] for r in warehouse.facts("sales").collect()) == ["s-08", "s-09", "s-10"]
    refresh(warehouse, sales_job(path), since=day(19))
    assert warehouse.facts("sales").count() == 5
    assert warehouse.watermark("sales_csv") == day(25)


def test_insert_if_absent_does_not_repeat_facts(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
    job = sales_job(path, insert_if_absent=True)
    refresh(warehouse, job)
    run = refresh(warehouse, job, since=day(19)).first()
    assert (run["rows_processed"], run["rows_inserted"]) == (2, 0)
    assert warehouse.facts("sales").count() == 10


def test_price_change_makes_a_second_version(warehouse, tmp_path):
    def job(rows):
        path = write_csv(tmp_path / "p.csv", PRODUCTS_HEADER, rows)
        source = Source("products_csv", "csv", "product", {"path": path})
        return Job((source,), (Cube("sales", ("products_csv",), dimensions=("product",)),))

    refresh(warehouse, job(PRODUCTS[:2]), as_of=day(1))
    changed = ["oak,Oak sapling,Hardwood,24.50,2024-01-15", PRODUCTS[1]]
    run = refresh(warehouse, job(changed), as_of=day(15)).first()
    assert (run["rows_inserted"], run["rows_updated"]) == (1, 1)
    assert warehouse.current("product").count() == 2
    versions = warehouse.dimension("product", {"product_id": "oak"}).orderBy("valid_from").collect()
    assert [(v["price"], v["valid_from"], v["valid_to"], v["is_current"]) for v in versions] == [
        (21.0, day(1), day(15), False),
        (24.5, day(15), None, True),
    ]
    again = refresh(warehouse, job(changed), as_of=day(16)).first()
    assert (again["rows_inserted"], again["rows_updated"]) == (0, 0)
    assert warehouse.dimension("product").count() == 3


def test_cube_over_the_versions_valid_at_the_sale(warehouse, tmp_path):
    def job(category):
        products = write_csv(tmp_path / "p.csv", PRODUCTS_HEADER, [f"oak,Oak sapling,{category},21.00,2023-12-01"])
        sales = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
        cube = Cube("c", ("s", "p"), dimensions=("product",), measures=("amount",), fact_attributes=())
        sources = (Source("s", "csv", "sales", {"path": sales}, "sale_date"), Source("p", "csv", "product", {"path": products}))
        return Job(sources, (cube, replace(cube, name="then", versions_at="sale_date")))

    refresh(warehouse, job("Old"), as_of=day(1))
    refresh(warehouse, job("New"), as_of=day(20))

    def sums(name):
        return {r["category"]: float(r["amount"]) for r in warehouse.cube(name).filter("grouping_id = 0").collect()}

    assert sums("c") == {"New": 378.0, None: 351.0}
    assert sums("then") == {"Old": 231.0, "New": 147.0, None: 351.0}


def test_invalidation_names_cube_and_sources_and_can_be_cleared(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES[:1])
    refresh(warehouse, sales_job(path), as_of=day(1, 3))
    event = warehouse.invalidations("sales").first()
    assert (event["cube"], event["sources"]) == ("sales", ["sales_csv"])
    warehouse.clear_invalidations(utc_now(), "sales")
    assert warehouse.invalidations().count() == 0
    warehouse.invalidate("sales", ["x"], utc_now(), "by hand")
    assert warehouse.invalidations().count() == 1


def test_uncommitted_batch_is_invisible(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
    refresh(warehouse, sales_job(path))
    lost = warehouse.facts("sales").withColumn("region", F.lit("lost"))
    from tidemark.contracts import SALES as CONTRACT

    warehouse.append_facts(CONTRACT, lost, "half-written", None)
    assert warehouse.facts("sales").count() == 10


def test_unknown_cube_is_an_error(warehouse, tmp_path):
    with pytest.raises(ValueError, match="no cube"):
        refresh(warehouse, star_job(tmp_path), "nope")


def test_job_from_config(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
    job = job_from_config(
        {
            "sources": [
                {
                    "name": "s",
                    "type": "csv",
                    "connection": {"filePath": path, "hasHeader": True},
                    "schema": "sales",
                    "watermarkColumn": "sale_date",
                },
                {
                    "name": "db",
                    "type": "postgres",
                    "connection": {
                        "host": "h",
                        "port": 5432,
                        "database": "d",
                        "user": "u",
                        "password": "p",
                        "table": "sales",
                    },
                    "schema": "sales",
                },
            ],
            "cubes": [
                {
                    "name": "sales",
                    "factTable": "fact_sales",
                    "dimensions": [],
                    "measures": ["quantity"],
                    "sources": ["s"],
                }
            ],
        }
    )
    assert refresh(warehouse, job).first()["rows_inserted"] == 10
    assert job.sources[1].options["url"] == "jdbc:postgresql://h:5432/d"


def test_a_cleared_table_is_empty_until_it_is_loaded_again(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
    refresh(warehouse, sales_job(path))
    warehouse.clear("sales", day(1, 3))
    assert warehouse.facts("sales").count() == 0
    assert warehouse.watermark("sales_csv") == day(25)
    assert warehouse.stats().count() == 0
    refresh(warehouse, sales_job(path), since=day(19))
    assert warehouse.facts("sales").count() == 2
    assert [tuple(r) for r in warehouse.stats().collect()] == [("fact_sales", 2)]


def test_listeners_see_each_invalidation_once(warehouse, tmp_path):
    seen = []

    def listen():
        stream = warehouse.invalidation_stream().writeStream.trigger(availableNow=True)
        stream.option("checkpointLocation", str(tmp_path / "listener")).foreachBatch(
            lambda rows, _: seen.extend(r["reason"] for r in rows.collect())
        ).start().awaitTermination()

    warehouse.invalidate("sales", ["a"], day(1), "first")
    listen()
    warehouse.invalidate("sales", ["a"], day(2), "second")
    listen()
    assert seen == ["first", "second"]


def test_a_source_of_two_cubes_is_loaded_once(warehouse, tmp_path):
    path = write_csv(tmp_path / "s.csv", SALES_HEADER, SALES)
    job = sales_job(path)
    both = Job(job.sources, (*job.cubes, Cube("again", ("sales_csv",), measures=("amount",))))
    runs = {r["cube"]: r for r in refresh(warehouse, both, since=day(14)).collect()}
    assert (runs["sales"]["rows_inserted"], runs["again"]["rows_inserted"]) == (4, 0)
    assert warehouse.facts("sales").count() == 4
    assert warehouse.cube("again").filter("region IS NULL").first()["row_count"] == 4
    assert warehouse.invalidations("again").count() == 1


def test_command_line(spark, tmp_path, capsys):
    from tidemark.__main__ import main

    good = write_csv(tmp_path / "good.csv", SALES_HEADER, SALES)
    bad = write_csv(tmp_path / "bad.csv", SALES_HEADER, SALES_INVALID)

    def source(name, path):
        connection = {"filePath": path, "hasHeader": True}
        return {"name": name, "type": "csv", "connection": connection, "schema": "sales", "watermarkColumn": "sale_date"}

    def cube(name, *sources):
        return {"name": name, "factTable": "fact_sales", "dimensions": [], "measures": ["amount"], "sources": list(sources)}

    config = tmp_path / "job.json"
    config.write_text(
        json.dumps(
            {
                "sources": [source("good", good), source("bad", bad)],
                "target": {"type": "memory"},
                "cubes": [cube("sales", "good"), cube("broken", "bad")],
            }
        )
    )
    common = ["run", "--config", str(config), "--warehouse", str(tmp_path / "cli")]
    assert main([*common, "--cube", "sales", "--since", "2024-01-14T00:00:00Z"]) == 0
    out = capsys.readouterr().out
    assert "good" in out and "fact_sales" in out and "4" in out
    assert main([*common, "--cube", "broken"]) == 1
    assert "3 rows failed, 1 rows passed" in capsys.readouterr().out
    assert main([*common, "--since", "yesterday"]) == 1
    assert "ISO date" in capsys.readouterr().err
    assert main([*common, "--cube", "nope"]) == 1


@pytest.mark.parametrize("fold_parts", [2, 16])
def test_rebuilds_from_sums_equal_a_cube_of_all_facts(warehouse, tmp_path, monkeypatch, fold_parts):
    monkeypatch.setattr("tidemark.plans.grains.FOLD_PARTS", fold_parts)

    def expected(rows, segments):
        sums = {}
        for row in rows:
            _, _, customer, _, amount, _, region = row.split(",")
            key = (region, segments[customer])
            sums[key] = round(sums.get(key, 0) + float(amount), 2)
        return sums

    def found():
        rows = warehouse.cube("c").filter("grouping_id = 0").collect()
        return {(r["region"], r["segment"]): float(r["amount"]) for r in rows}

    def load(sales, customers):
        job = Job(
            (
                sales_source(write_csv(tmp_path / "s.csv", SALES_HEADER, sales)),
                Source(
                    "customers",
                    "csv",
                    "customer",
                    {"path": write_csv(tmp_path / "c.csv", CUSTOMERS_HEADER, customers)},
                ),
            ),
            (Cube("c", ("sales_csv", "customers"), dimensions=("customer",), measures=("amount",)),),
        )
        refresh(warehouse, job)
        return expected(sales, segments_of(customers))

    assert load(SALES[:4], CUSTOMERS) == found()
    moved = [c.replace("Trade", "Public") for c in CUSTOMERS]
    assert load(SALES[:8], moved) == found()
    assert load(SALES[:8], CUSTOMERS) == found()
    warehouse.clear("sales", day(1))
    load([*SALES, *SALES_LATER], CUSTOMERS)
    assert found() == expected([*SALES[8:], *SALES_LATER], segments_of(CUSTOMERS))


def segments_of(customers):
    return {c.split(",")[0]: c.split(",")[3] for c in customers}
