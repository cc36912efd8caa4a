from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.fixtures import SALES_HEADER, SALES_INVALID
from tidemark.contracts import SALES, Contract, Field
from tidemark.operators.quality import (
    duplicate_keys,
    duplicate_rows,
    error_report,
    report_header,
    validate_counts,
    validate_errors,
    validate_gate,
)
from tidemark.operators.staging import batch_row_ordinal, ordered_batch, with_position, write_staged

COLUMNS = SALES_HEADER.split(",")
SCHEMA = "_row bigint, " + ", ".join(f"{c} string" for c in COLUMNS)


def batch(spark, rows):
    return spark.createDataFrame([(i, *r.split(",")) for i, r in enumerate(rows)], SCHEMA)


def found(errors):
    return [(r["_row"], r["field"], r["message"], r["value"]) for r in errors.orderBy("_row", "issue_no").collect()]


def test_a_valid_row(spark):
    rows = batch(spark, ["7,oak,ada,2,42.00,2024-01-15,Coast"])
    assert validate_errors(rows, SALES).count() == 0
    assert validate_counts(rows, SALES).first().asDict() == {
        "rows_processed": 1,
        "rows_passed": 1,
        "rows_failed": 0,
        "valid": True,
    }


def test_a_missing_column(spark):
    rows = batch(spark, ["7,oak,ada,2,42.00,2024-01-15,Coast"]).drop("customer_id")
    assert found(validate_errors(rows, SALES)) == [
        (0, "customer_id", "Invalid input", None),
        (0, "customer_id", "Required field is missing or empty", None),
    ]
    assert validate_counts(rows, SALES).first()["rows_failed"] == 1


def test_duplicates_report_every_row_but_the_first(spark):
    rows = batch(spark, [f"{i},P,C,1,1,2024-01-15,N" for i in (1, 1, 2, 1)])
    assert found(validate_errors(rows, SALES)) == [
        (1, "id", "Duplicate value found", "1"),
        (3, "id", "Duplicate value found", "1"),
    ]


def test_invalid_sample(spark):
    rows = batch(spark, SALES_INVALID)
    errors = validate_errors(rows, SALES)
    assert found(errors) == [
        (1, "customer_id", "Required field is missing or empty", ""),
        (2, "quantity", "Number must be greater than 0", "-6"),
        (3, "sale_date", "Invalid date", "someday"),
        (3, "product_id", "Required field is missing or empty", ""),
    ]
    counts = validate_counts(rows, SALES).first()
    assert (counts["rows_passed"], counts["rows_failed"], counts["valid"]) == (1, 3, False)
    last = error_report(errors).orderBy(F.desc("_row")).first()
    assert last["issues"] == 2
    assert last["report"] == (
        "  Row 3:\n"
        '    - sale_date: Invalid date (value: "someday")\n'
        '    - product_id: Required field is missing or empty (value: "")'
    )
    assert report_header(3, 1) == "Validation failed: 3 rows failed, 1 rows passed"
    assert report_header(0, 1) == "All rows passed validation"


def expected_errors(rows):
    """The rules written out row by row, as a check of the column form."""
    seen, out = set(), []
    for i, text in enumerate(rows):
        id_, product, customer, quantity, amount, date, region = text.split(",")
        for field, value in (("quantity", quantity), ("amount", amount)):
            try:
                if float(value) <= 0:
                    out.append((i, field, "Number must be greater than 0", value))
            except ValueError:
                out.append((i, field, "Expected number, received string", value))
        if not date.startswith("2024"):
            out.append((i, "sale_date", "Invalid date", date))
        if not region:
            out.append((i, "region", "String must contain at least 1 character(s)", region))
        required = (("id", id_), ("product_id", product), ("customer_id", customer), ("quantity", quantity), ("amount", amount))
        out += [(i, f, "Required field is missing or empty", v) for f, v in required if v == ""]
        if id_ in seen:
            out.append((i, "id", "Duplicate value found", id_))
        seen.add(id_)
    return out


@pytest.mark.parametrize("hot_rows", [1_000_000, 3])
def test_random_batches_match_row_by_row_checks(spark, hot_rows):
    rng = random.Random(7)
    pick = rng.choice
    rows = [
        ",".join(
            [
                "7" if rng.random() < 0.4 else str(rng.randint(1, 60)),
                pick(["P1", "P2", ""]),
                pick(["C1", "C2", ""]),
                pick(["1", "2.5", "-1", "0", "many", ""]),
                pick(["10", "0.00", "x"]),
                pick(["2024-01-05", "2024-03-09T10:00:00Z", "soon", ""]),
                pick(["Coast", ""]),
            ]
        )
        for _ in range(200)
    ]
    frame = batch(spark, rows)
    expected = expected_errors(rows)
    assert found(validate_errors(frame, SALES, hot_rows=hot_rows)) == expected
    counts = validate_counts(frame, SALES, hot_rows=hot_rows).first()
    failed = len({e[0] for e in expected})
    assert (counts["rows_processed"], counts["rows_failed"], counts["rows_passed"]) == (200, failed, 200 - failed)


def test_missing_values_repeat_each_other(spark):
    rows = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, None)], "_row bigint, k string")
    for hot_rows in (1_000_000, 2):
        assert sorted(r["_row"] for r in duplicate_rows(rows, ["k"], hot_rows=hot_rows).collect()) == [2, 3]
    assert duplicate_keys(rows, ["k"]).first() == (None, 0, 3)


def test_two_unique_fields_count_a_row_once(spark):
    contract = Contract("pair", "fact", (Field("a", "key"), Field("b", "key")), unique=("a", "b"))
    rows = spark.createDataFrame([(0, "1", "x"), (1, "1", "x"), (2, "1", "y")], "_row bigint, a string, b string")
    counts = validate_counts(rows, contract).first()
    assert (counts["rows_passed"], counts["rows_failed"]) == (1, 2)
    assert validate_errors(rows, contract).count() == 3


def test_gate_keeps_clean_batches_only(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4)], "source string, v int")
    errors = spark.createDataFrame([("a",), ("a",), (None,)], "source string")
    assert [r["v"] for r in validate_gate(rows, errors).collect()] == [3]


def test_ordinals_follow_the_batch_over_several_files(spark):
    frame = spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("n"), F.lit("x").alias("pad"))
    staged = batch_row_ordinal(with_position(write_staged(frame)))
    assert staged.filter("_row * 3 <> n").count() == 0
    assert staged.agg(F.min("_row"), F.max("_row"), F.countDistinct("_row")).first() == (0, 999, 1000)
    shuffled = frame.orderBy(F.rand(3))
    ordered = batch_row_ordinal(ordered_batch(shuffled, ["n"]))
    assert ordered.filter("_row * 3 <> n").count() == 0


def test_positions_with_several_files_per_task(spark):
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "10")
    try:
        staged = with_position(write_staged(spark.range(0, 100, 1, 2)))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert batch_row_ordinal(staged).filter("_row <> id").count() == 0
