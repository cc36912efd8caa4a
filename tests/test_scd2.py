from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.fixtures import day
from tidemark.contracts import PRODUCT, typed_projection
from tidemark.operators import scd2
from tidemark.plans import Warehouse

COLUMNS = "product_id string, name string, price double"
DIMENSION = COLUMNS + ", valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
KEY, COMPARE = ["product_id"], ["name", "price"]


def dimension(spark, *rows):
    return spark.createDataFrame([(*r, day(1), None, True) for r in rows], DIMENSION)


def incoming(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


@pytest.mark.parametrize("unique_keys", [True, False])
@pytest.mark.parametrize(
    ("stored", "batch", "inserted", "closed"),
    [
        ([], [("oak", "Oak sapling", 21.0)], 1, 0),
        ([("oak", "Oak sapling", 21.0)], [("oak", "Oak sapling", 24.5)], 1, 1),
        ([("oak", "Oak sapling", 21.0)], [("oak", "Oak sapling", 21.0)], 0, 0),
        (
            [("oak", "Oak sapling", 21.0), ("elm", "Elm sapling", 19.5)],
            [("oak", "Oak sapling", 21.0), ("elm", "Elm sapling", 22.5), ("fir", "Fir sapling", 1.0)],
            2,
            1,
        ),
        ([("oak", None, None)], [("oak", None, None)], 0, 0),
        ([("oak", None, 1.0)], [("oak", "Oak sapling", 1.0)], 1, 1),
    ],
)
def test_inserts_and_closes(spark, stored, batch, inserted, closed, unique_keys):
    current, rows = dimension(spark, *stored), incoming(spark, *batch)
    options = {"as_of": day(20), "unique_keys": unique_keys}
    new = scd2.scd2_inserts(current, rows, KEY, COMPARE, **options).collect()
    old = scd2.scd2_closes(current, rows, KEY, COMPARE, **options).collect()
    assert (len(new), len(old)) == (inserted, closed)
    assert all((r["valid_from"], r["valid_to"], r["is_current"]) == (day(20), None, True) for r in new)
    assert all((r["valid_from"], r["valid_to"], r["is_current"]) == (day(1), day(20), False) for r in old)


def test_columns_outside_the_comparison_change_nothing(spark):
    current = dimension(spark, ("oak", "Oak sapling", 21.0))
    rows = incoming(spark, ("oak", "Renamed", 21.0))
    assert scd2.scd2_delta(current, rows, KEY, ["price"], day(20)).count() == 0


def test_incoming_validity_is_overwritten_and_columns_are_checked(spark):
    current = dimension(spark)
    rows = incoming(spark, ("oak", "Oak sapling", 21.0)).withColumn("valid_from", F.lit("1999-01-01").cast("timestamp_ntz"))
    assert scd2.scd2_inserts(current, rows, KEY, COMPARE, day(20)).first()["valid_from"] == day(20)
    with pytest.raises(ValueError, match="price"):
        scd2.scd2_delta(current, rows.drop("price"), KEY, COMPARE, day(20))


@pytest.mark.parametrize("hot_rows", [1_000_000, 2])
def test_repeated_and_missing_keys_in_a_batch(spark, hot_rows):
    current = dimension(spark, ("oak", "Oak sapling", 21.0), (None, "No key", 1.0), ("ash", "Idle", 9.0))
    rows = incoming(
        spark,
        ("oak", "Oak sapling", 31.0),
        ("oak", "Oak sapling", 32.0),
        ("oak", "Oak sapling", 21.0),
        (None, "No key", 2.0),
        ("yew", "New", 5.0),
        ("yew", "New", 6.0),
    )
    merged = scd2.scd2_merge(current, rows, KEY, COMPARE, day(20), hot_rows=hot_rows)
    got = sorted(((r["product_id"] or "", r["price"], r["is_current"]) for r in merged.collect()))
    assert got == sorted(
        [
            ("oak", 21.0, False),
            ("oak", 31.0, True),
            ("oak", 32.0, True),
            ("", 1.0, False),
            ("", 2.0, True),
            ("yew", 5.0, True),
            ("yew", 6.0, True),
            ("ash", 9.0, True),
        ]
    )


def test_latest_of_several_current_versions_counts(spark):
    rows = [("oak", "Oak sapling", 10.0, day(1), None, True), ("oak", "Oak sapling", 20.0, day(5), None, True)]
    current = spark.createDataFrame(rows, DIMENSION)
    same = incoming(spark, ("oak", "Oak sapling", 20.0))
    assert scd2.scd2_delta(current, same, KEY, COMPARE, day(20)).count() == 0
    merged = scd2.scd2_merge(current, incoming(spark, ("oak", "Oak sapling", 25.0)), KEY, COMPARE, day(20))
    assert sorted((r["price"], r["is_current"]) for r in merged.collect()) == [(10.0, True), (20.0, False), (25.0, True)]


def test_history_keeps_its_invariants_over_many_batches(spark):
    rng = random.Random(3)
    table = dimension(spark)
    state: dict[str, float] = {}
    versions = 0
    for step in range(1, 6):
        batch = {f"P{rng.randint(1, 12):03}": float(rng.randint(1, 3)) for _ in range(8)}
        versions += sum(1 for k, v in batch.items() if state.get(k) != v)
        state.update(batch)
        rows = incoming(spark, *[(k, "x", v) for k, v in batch.items()])
        args = (KEY, COMPARE, day(step))
        merged = scd2.scd2_merge(table, rows, *args, unique_keys=True)
        general = scd2.scd2_merge(table, rows, *args)
        assert sorted(map(str, merged.collect())) == sorted(map(str, general.collect()))
        table = spark.createDataFrame(merged.collect(), DIMENSION)
        again = scd2.scd2_merge(table, rows, *args, unique_keys=True)
        assert sorted(map(str, again.collect())) == sorted(map(str, table.collect()))
    assert {r["product_id"]: r["price"] for r in scd2.scd2_current(table).collect()} == state
    assert table.count() == versions
    spans = sorted((r["product_id"], r["valid_from"], r["valid_to"]) for r in table.filter("valid_to IS NOT NULL").collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spans, spans[1:], strict=False))
    shown = {r["product_id"] for r in scd2.scd2_as_of(table, day(3)).collect()}
    assert shown == {r["product_id"] for r in table.filter(F.col("valid_from") <= F.lit(day(3))).collect()}


@pytest.mark.parametrize("slot", ["hour", "day", "month"])
def test_as_of_join_matches_a_scan_of_all_versions(spark, slot):
    rng = random.Random(11)
    start = datetime(2024, 1, 1)
    versions = []
    for key in range(6):
        at = start + timedelta(hours=rng.randint(0, 30))
        for number in range(rng.randint(1, 8)):
            until = at + timedelta(hours=rng.randint(0, 60))
            closed = number % 3 == 2
            versions.append((f"K{key}", f"{key}-{number}", at, until, False))
            at = until + timedelta(hours=rng.randint(0, 20) if closed else 0)
        versions.append((f"K{key}", f"{key}-last", at, None, True))
    facts = [
        (i, "K0" if rng.random() < 0.5 else f"K{rng.randint(0, 7)}", start + timedelta(hours=rng.randint(-5, 500)))
        for i in range(300)
    ]
    facts += [(300, None, start), (301, "K1", None)]
    dim = spark.createDataFrame(
        versions, "k string, label string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
    )
    frame = spark.createDataFrame(facts, "i int, k string, at timestamp_ntz")
    joined = scd2.as_of_join(frame, dim, "k", "at", ["label"], slot=slot)
    expected = []
    for i, k, at in facts:
        hits = [v[1] for v in versions if v[0] == k and at and v[2] <= at and (v[3] is None or at < v[3])]
        expected.append((i, hits[0] if hits else None))
        assert len(hits) <= 1
    assert sorted((r["i"], r["label"]) for r in joined.collect()) == sorted(expected)


@pytest.mark.parametrize("share", [0.0, 0.3, 100.0])
def test_a_stored_dimension_equals_the_merged_frame(spark, tmp_path, monkeypatch, share):
    """Whatever the base is rewritten for, readers see the same versions."""
    monkeypatch.setattr("tidemark.plans.dimension.REBASE_SHARE", share)
    warehouse = Warehouse(spark, str(tmp_path / "w"))
    rng = random.Random(4)
    table = typed_projection(spark.createDataFrame([], DIMENSION), PRODUCT)
    bases = 0
    for step in range(1, 5):
        prices = {f"P{rng.randint(1, 6)}": float(rng.randint(1, 3)) for _ in range(4)}
        batch = spark.createDataFrame(
            [(k, "x", "c", p, day(1)) for k, p in prices.items()],
            "product_id string, product_name string, category string, price double, valid_from timestamp_ntz",
        )
        typed = typed_projection(batch, PRODUCT)
        # Two merges of one run share their moment.
        moment = day(step - step % 2 + 1)
        done = warehouse.dimension_table("product").merge(typed, f"b{step}", moment)
        lost = warehouse.dimension_table("product").merge(typed, "lost", moment)
        assert lost[:2] == done[:2]
        warehouse.commit(f"b{step}", "dim_product", "s", None, done.inserted, done.closed, day(step), done.rebased)
        bases += done.rebased
        table = scd2.scd2_merge(table, typed, PRODUCT.key, PRODUCT.compare, moment, unique_keys=True)
        table = spark.createDataFrame(table.collect(), PRODUCT.schema)
        assert sorted(map(str, warehouse.dimension("product").collect())) == sorted(map(str, table.collect()))
        assert warehouse.current("product").filter("NOT is_current").count() == 0
    assert (bases > 0) == (share < 1)
    assert warehouse.stats().first()["row_count"] == table.count()
