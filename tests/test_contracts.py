from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tests.fixtures import day
from tidemark.contracts import (
    CUSTOMER,
    PRODUCT,
    SALES,
    Contract,
    Field,
    contract_named,
    field_issue,
    typed_projection,
)
from tidemark.functions import as_flag, as_instant, as_number


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("12", 12.0),
        (" -3.50 ", -3.5),
        ("1e3", 1000.0),
        (".5", 0.5),
        ("+7.", 7.0),
        ("", None),
        ("1d", None),
        ("0x1F", None),
        ("NaN", None),
        ("Infinity", None),
        ("1e999", None),
        ("12 apples", None),
    ],
)
def test_numbers(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(as_number(F.col("t"), T.StringType()).alias("v")).first()
    assert row["v"] == expected


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024-01-15", day(15)),
        ("2024-01-15T10:00:00Z", day(15, hour=10)),
        ("2024-01-15 10:00:00", day(15, hour=10)),
        ("2024-01-15T12:00:00+02:00", day(15, hour=10)),
        ("2024-1-5", day(5)),
        ("10:30", None),
        ("T10:30", None),
        ("2024-02-30", None),
        ("invalid-date", None),
        ("1/15/2024", None),
        ("", None),
    ],
)
def test_instants(spark, text, expected):
    frame = spark.createDataFrame([(text,)], "t string").select(as_instant(F.col("t"), T.StringType()).alias("v"))
    assert frame.schema["v"].dataType == T.TimestampNTZType()
    assert frame.first()["v"] == expected


def test_flags(spark):
    frame = spark.createDataFrame([("true",), ("FALSE",), ("yes",), ("",)], "t string")
    values = [r["v"] for r in frame.select(as_flag(F.col("t"), T.StringType()).alias("v")).collect()]
    assert values == [True, False, None, None]


@pytest.mark.parametrize(
    ("mail", "ok"),
    [
        ("john@example.com", True),
        ("a.b+c'd_e@sub.example.org", True),
        ("John.Doe@EXAMPLE.COM", True),
        (".john@example.com", False),
        ("jo..hn@example.com", False),
        ("john.@example.com", False),
        ("john@example", False),
        ("john@-example.com", False),
        ("john doe@example.com", False),
        ("", False),
    ],
)
def test_mail_addresses(spark, mail, ok):
    frame = spark.createDataFrame([(mail,)], "email string")
    issue = frame.select(field_issue(frame, CUSTOMER, "email").alias("m")).first()["m"]
    assert issue == (None if ok else "Invalid email")


def test_missing_values_per_kind(spark):
    frame = spark.createDataFrame([(1,)], "other int")
    names = [*SALES.columns]
    found = frame.select(*[field_issue(frame, SALES, n).alias(n) for n in names]).first().asDict()
    assert found == {
        "id": "Invalid input",
        "product_id": "Invalid input",
        "customer_id": "Invalid input",
        "quantity": "Required",
        "amount": "Required",
        "sale_date": "Invalid date",
        "region": "Required",
        "updated_at": None,
    }
    optional = frame.select(*[field_issue(frame, CUSTOMER, n).alias(n) for n in ("email", "valid_to", "is_current")])
    assert optional.first() == (None, None, None)


def test_typed_columns_pass_without_a_text_round_trip(spark):
    frame = spark.createDataFrame(
        [("P1", "Lamp", "Home", 12, day(1), None, None)],
        "product_id string, product_name string, category string, price int, valid_from timestamp_ntz, "
        "valid_to timestamp_ntz, is_current boolean",
    )
    typed = typed_projection(frame, PRODUCT)
    assert typed.schema.simpleString() == PRODUCT.schema.simpleString()
    assert typed.first() == ("P1", "Lamp", "Home", 12.0, day(1), None, True)
    nan = spark.createDataFrame([(float("nan"),), (-1.0,), (0.0,), (2.0,)], "price double")
    issues = [r[0] for r in nan.select(field_issue(nan, PRODUCT, "price")).collect()]
    assert issues == [
        "Expected number, received nan",
        "Number must be greater than 0",
        "Number must be greater than 0",
        None,
    ]


def test_decimals_are_numbers(spark):
    frame = spark.sql("SELECT CAST(30.00 AS DECIMAL(10,2)) AS price")
    assert frame.select(field_issue(frame, PRODUCT, "price")).first()[0] is None


def test_unknown_contract_and_bad_definitions():
    with pytest.raises(KeyError, match="no contract"):
        contract_named("nope")
    with pytest.raises(ValueError, match="unknown role"):
        Contract("x", "view", ())
    with pytest.raises(ValueError, match="no field"):
        Contract("x", "fact", (Field("id", "key"),), required=("name",))
