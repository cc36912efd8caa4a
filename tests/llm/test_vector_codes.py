"""Codes and codebooks against plain integers."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import vector_codes as codes

SCHEMA = "vec_id long, embedding array<double>, label int, x string, code string"


def plain(rows, parts, entries, rounds, scale=codes.SCALE):
    kept = [r for r in rows if r.embedding is not None and all(x is not None and math.isfinite(x) for x in r.embedding)]
    if not kept:
        return [], []
    width = -(-max(len(r.embedding) for r in kept) // parts)
    kept.sort(key=lambda r: (r.vec_id is None, r.vec_id or 0, r.embedding))
    whole = [[math.floor(scale * x) if abs(x) < 1e100 else scale * int(x) for x in r.embedding] for r in kept]
    whole = [v + [0] * (parts * width - len(v)) for v in whole]
    cut = [[v[p * width : (p + 1) * width] for p in range(parts)] for v in whole]
    books = [[v[p] for v in cut[:entries]] for p in range(parts)]

    def nearest(p, own):
        return min((sum((a - b) ** 2 for a, b in zip(own, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        near = [[nearest(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                own = [v[p] for v, k in zip(cut, near) if k[p] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    sums, out = defaultdict(int), []
    for r, v in zip(kept, cut):
        found = [nearest(p, v[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        error = error if error < 1 << 63 else None
        sums[r.label] = sums[r.label] if error is None else sums[r.label] + error
        out.append([r.vec_id, r.label, bytes(k for _, k in found), error])
    some = {r[1] for r in out if r[3] is not None}
    return [(*r, sums[r[1]] if r[1] in some and sums[r[1]] < 1 << 63 else None) for r in out], books


def check(vectors, folder, parts=codes.PARTS, entries=codes.ENTRIES, rounds=codes.ROUNDS):
    coded, books = codes.encode(vectors, str(folder), parts, entries, rounds)
    found = sorted(((r.vec_id, r.label, bytes(r.code), r.error, r.label_error) for r in coded.collect()), key=str)
    expected, expected_books = plain(vectors.collect(), parts, entries, rounds)
    assert books == expected_books
    assert found == sorted(expected, key=str)
    return found


def vectors(spark, size=64, large=()):
    draw = random.Random(11)
    rows = [(k, [draw.uniform(-1, 1) for _ in range(size)], draw.choice([None, 1, 2])) for k in range(300)]
    rows += [(300 + k, [0.0] * size, 1) for k in range(200)] + [rows[5], rows[5], (5, rows[6][1], 2)]  # ties and repeated rows
    rows += [(600, None, 1), (601, [None] * size, 1), (602, [math.nan] + [0.0] * (size - 1), 1), (603, [math.inf] * size, None)]
    rows += [(None, [0.5] * size, None), (604, [-1e-9] * size, None), (605, [0.25], 2), (606, [], 2)]
    rows += [(700 + k, [x] * (size // 2) + [0.0] * (size // 2), 3) for k, x in enumerate(large)]
    draw.shuffle(rows)
    return spark.createDataFrame([(*r, "x", "c") for r in rows], SCHEMA).repartition(5)


@pytest.mark.parametrize("size", [64, 20])
def test_codes(spark, tmp_path, size):
    assert len(check(vectors(spark, size), tmp_path)) == 300 + 200 + 3 + 4


def test_large_numbers(spark, tmp_path):
    # From 64-bit products that pass 2^53 up to numbers and errors far beyond 64 bits.
    check(vectors(spark, 8, [1e4, -3e4, 1e5, 3e5, -1e9, 1e12, 1e30, -1e30, 1e38]), tmp_path, parts=2, entries=4, rounds=3)


def test_fewer_vectors_than_entries(spark, tmp_path):
    assert len(check(vectors(spark).filter("vec_id < 3"), tmp_path)) == 3


def test_no_vectors(spark, tmp_path):
    assert check(vectors(spark).limit(0), tmp_path) == []
    assert check(vectors(spark).filter("vec_id = 600"), tmp_path) == []


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.integers(1, 40), st.data())
def test_exact_products(width, bits, data):
    numbers = st.lists(st.lists(st.integers(-(1 << bits), 1 << bits), min_size=width, max_size=width), min_size=1, max_size=5)
    a, b = (np.array(data.draw(numbers), np.int64) for _ in range(2))
    found = codes.dot_products(a, b)
    for x, row in zip(a.tolist(), found.tolist()):
        for y, product in zip(b.tolist(), row):
            assert (product - sum(p * q for p, q in zip(x, y))) % (1 << 64) == 0
    if max(np.abs(a).max(), np.abs(b).max()) <= codes.largest(width):
        near = codes.distances(a, b)
        assert near.tolist() == [[sum((p - q) ** 2 for p, q in zip(x, y)) for y in b.tolist()] for x in a.tolist()]
