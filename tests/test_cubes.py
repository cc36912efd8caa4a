from __future__ import annotations

import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.operators.cubes import DimensionJoin, build_cube, star_join
from tidemark.operators.upsert import absent_rows, insert_if_absent, table_scan_eq, table_stats


@pytest.fixture(scope="module")
def star(spark):
    rng = random.Random(5)

    def customer():
        return "C1" if rng.random() < 0.4 else f"C{rng.randint(1, 9)}"

    facts = [(f"P{rng.randint(1, 6)}", customer(), rng.choice("NS"), rng.randint(1, 500) / 100) for _ in range(400)]
    products = {f"P{i}": rng.choice(["toys", "tools"]) for i in range(1, 6)}
    customers = {f"C{i}": rng.choice(["gold", "plain", None]) for i in range(1, 10)}
    return (
        spark.createDataFrame(facts, "product_id string, customer_id string, region string, amount double"),
        [
            DimensionJoin(
                spark.createDataFrame(list(products.items()), "product_id string, category string"),
                "product_id",
                "product_id",
                ("category",),
            ),
            DimensionJoin(
                spark.createDataFrame(list(customers.items()), "customer_id string, segment string"),
                "customer_id",
                "customer_id",
                ("segment",),
            ),
        ],
        [(r, products.get(p), customers.get(c), a) for p, c, r, a in facts],
    )


BY = ["region", "category", "segment"]


def brute(rows, sets):
    sums = defaultdict(lambda: [0, 0])
    for kept in sets:
        for *members, amount in rows:
            gid = sum(1 << (2 - i) for i in range(3) if i not in kept)
            key = (gid, *[m if i in kept else None for i, m in enumerate(members)])
            sums[key][0] += round(amount * 100)
            sums[key][1] += 1
    return {k: tuple(v) for k, v in sums.items()}


def found(cube):
    return {
        (r["grouping_id"], *[r[c] for c in BY]): (round(float(r["amount"]) * 100), r["row_count"]) for r in cube.collect()
    }


ALL_SETS = [set(s) for n in range(4) for s in itertools.combinations(range(3), n)]


@pytest.mark.parametrize("collapse_first", [False, True])
def test_cube(star, collapse_first):
    fact, dims, rows = star
    cube = build_cube(fact, dims, BY, ["amount"], collapse_first=collapse_first)
    assert found(cube) == brute(rows, ALL_SETS)


def test_rollup_and_grouping_sets(star):
    fact, dims, rows = star
    rollup = build_cube(fact, dims, BY, ["amount"], mode="rollup")
    assert found(rollup) == brute(rows, [set(), {0}, {0, 1}, {0, 1, 2}])
    sets = build_cube(fact, dims, BY, ["amount"], mode="sets", sets=[["region", "segment"], ["category"], []])
    assert found(sets) == brute(rows, [{0, 2}, {1}, set()])
    with pytest.raises(ValueError, match="mode"):
        build_cube(fact, dims, BY, ["amount"], mode="pyramid")


def test_unknown_members_keep_their_facts(star):
    fact, dims, rows = star
    joined = star_join(fact, dims)
    assert joined.count() == len(rows)
    assert joined.filter("category IS NULL").count() == sum(1 for r in rows if r[1] is None)


def test_clashing_names_are_refused(star):
    fact, dims, _ = star
    with pytest.raises(ValueError, match="category"):
        star_join(fact.withColumn("category", F.lit("x")), dims)


def test_insert_if_absent(spark):
    target = spark.createDataFrame([("a", 0), (None, 0)], "k string, v int")
    batch = spark.createDataFrame([("a", 1), ("b", 3), ("b", 2), (None, 4), ("c", 5)], "k string, v int")
    order = [F.col("v")]
    assert sorted(absent_rows(target, batch, ["k"], order).collect()) == [("b", 2), ("c", 5)]
    assert insert_if_absent(target, batch, ["k"], order).count() == 4


def test_table_reads(spark):
    table = spark.createDataFrame([("a", 1), ("a", None), (None, 1)], "k string, v int")
    assert table_scan_eq(table, {"k": "a", "v": None}).count() == 1
    assert table_scan_eq(table, {"k": "a"}).count() == 2
    assert table_scan_eq(table).count() == 3
    assert sorted(table_stats({"x": table, "y": table.limit(0)}).collect()) == [("x", 3), ("y", 0)]
    with pytest.raises(ValueError, match="no tables"):
        table_stats({})
