"""Top-k against brute force."""

from __future__ import annotations

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm import cases
from tidemark.llm import queries, topk

SCHEMA = "vec_id long, embedding array<float>, block int, v string"


def plain(rows, k=5):
    taking = []
    for r in rows:
        x = r.embedding
        if r.vec_id is not None and x is not None and all(c is not None and math.isfinite(c) for c in x):
            taking.append((r.vec_id, [math.floor(256 * float(c)) for c in x]))
    found = Counter()
    for a, (i, x) in enumerate(taking):
        if i % 50 == 0:
            scores = sorted((-sum(p * q for p, q in zip(x, y)), j) for b, (j, y) in enumerate(taking) if a != b)
            found.update((i, n, j, -s) for n, (s, j) in enumerate(scores[:k], 1))
    return found


def run(vectors, folder):
    return Counter(tuple(r) for r in topk.top_k(vectors, F.col("vec_id") % 50 == 0, str(folder)).collect())


@pytest.mark.parametrize("sizes", [(4096, 2048, 1024), (37, 3, 8)])
def test_given_vectors(spark, tmp_path, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "QUERY_BLOCK", "CHUNK"), sizes):
        monkeypatch.setattr(topk, name, size)
    vectors = spark.read.parquet(f"{cases.SMALL}/embeddings.parquet")
    assert run(vectors, tmp_path) == plain(vectors.collect())


@pytest.mark.parametrize("sizes", [(4096, 2048, 1024), (20, 2, 8)])
def test_awkward_vectors(spark, tmp_path, monkeypatch, sizes):
    for name, size in zip(("BLOCK", "QUERY_BLOCK", "CHUNK"), sizes):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(2)
    rows = [(k, [float(x) for x in draw.integers(-2, 3, 4) * 3.0 ** draw.integers(-3, 9)], 1, "v") for k in range(220)]
    rows += [(300, None, 1, "v"), (301, [], 1, "v"), (350, [1.0, None, 2.0, 3.0], 1, "v"), (400, [math.nan] * 4, 1, "v")]
    rows += [(450, [math.inf, 0.0, 0.0, 0.0], 1, "v"), (None, [1.0] * 4, 1, "v"), (500, [0.0] * 4, 1, "v"), (501, [1.0], 1, "v")]
    rows += [*rows[:60], *rows[:1], (50, [9.0, 1.0, 0.0, 2.0], 1, "v"), (1, rows[2][1], 1, "v")]
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert run(vectors, tmp_path) == plain(vectors.collect())
    assert run(vectors.filter("vec_id < 3"), tmp_path / "few") == plain(vectors.filter("vec_id < 3").collect())
    assert run(vectors.limit(0), tmp_path / "none") == Counter()
    assert run(vectors.filter("vec_id = 7"), tmp_path / "no-query") == Counter()


def test_repeated_rows_against_sql(spark, tmp_path):
    draw = np.random.default_rng(6)
    rows = [(k, [float(x) for x in draw.integers(-2, 3, 4)], 1) for k in [0, 1, 1, 2, 3, 50, 50, *range(51, 90)]]
    rows += [rows[0], rows[1], rows[1], (None, [1.0] * 4, 1), (100, None, 1)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    expected = connection.execute(queries.EXPECTED["op6_top_k"])
    names = [d[0] for d in expected.description]
    found = queries.op6_top_k(spark, str(tmp_path)).select(*names)
    assert Counter(tuple(r) for r in found.collect()) == Counter(expected.fetchall())


def test_only_blocks_that_matter_meet(spark, tmp_path, monkeypatch):
    """Lengths fall off, so that most vectors are too short for any query and do not travel again."""
    for name, size in zip(("BLOCK", "QUERY_BLOCK"), (100, 4)):
        monkeypatch.setattr(topk, name, size)
    draw = np.random.default_rng(8)
    rows = [(k, [float(x) for x in draw.normal(size=8) * 50 / (1 + k % 1000)], 1, "v") for k in range(2000)]
    sent = []
    pairs = topk._pairs
    monkeypatch.setattr(topk, "_pairs", lambda *a: sent.append(pairs(*a)) or sent[0])
    vectors = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert run(vectors, tmp_path) == plain(vectors.collect())
    left, right = (frame.count() for frame in sent[0])
    assert left < 2000 * 10 / 4 and right < 40 * 20 / 4  # of all vectors times query blocks, of all queries times blocks


def test_bounds_prune():
    draw = np.random.default_rng(4)
    vectors = draw.normal(size=(3000, 48)) * np.linspace(8, 0.01, 48) * 256
    vectors = np.floor(vectors).astype(np.int64)
    turn = np.linalg.eigh(vectors.T.astype(float) @ vectors)[1][:, ::-1]
    best = topk.search_block(vectors[:40], np.arange(40), vectors, np.arange(3000), turn, 5)
    scores = vectors[:40] @ vectors.T
    np.fill_diagonal(scores, -(1 << 60))
    assert best.scores.reshape(40, 5).tolist() == (-np.sort(-scores, axis=1)[:, :5]).tolist()


def test_query_has_every_fiftieth_vector(spark):
    found = queries.op6_top_k(spark, cases.SMALL)
    asked = spark.read.parquet(f"{cases.SMALL}/embeddings.parquet").filter("vec_id % 50 = 0").count()
    assert found.groupBy("query_id").count().filter("count = 5").count() == asked
