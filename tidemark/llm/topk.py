"""Exact top-k by inner product, over norm-sorted blocks with a rotated, pruned scan.

Vectors become whole numbers. The sum of outer products of all of them, one small matrix, gives
the rotation (its eigenvectors, the right singular vectors of the table) that moves most of every
product into the first dimensions. Vectors are dealt out by ranges of their length into blocks of
bounded size. All queries meet the block of the longest vectors first. The k-th score found there,
divided by a query's length, is the least length of a vector that can still matter to it
(Cauchy-Schwarz). By that need queries are dealt into blocks; a vector travels to the query blocks
that need no longer one, a query to the blocks that hold one as long as it needs, and every pair of
blocks that is left makes a group. Inside a group the vectors go by, longest first, a chunk at a time. A chunk
whose longest vector cannot reach a query's k-th score ends the scan for it (Cauchy-Schwarz on
the whole vectors); within a chunk the product of the first dimensions plus the product of the
lengths of the rest bounds each score, and only pairs whose bound reaches the k-th score get their
exact product. Bounds are widened by more than floating point can lose, so none is pruned wrongly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.frames import arrow_schema, staged

SCALE = 256
#: Vectors in a block, in a block of queries, and looked at in one go.
BLOCK, QUERY_BLOCK, CHUNK = 4096, 2048, 1024
#: Dimensions of the first, partial sum.
LEADING = 24
#: Share of a bound that floating point may lose, many times over.
SLACK = 1e-9


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``v`` (64-bit integers as binary) and ``length`` of every row that takes part."""
    numbers = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), numbers.alias("x")).filter(
        "vec_id is not null and x is not null and not exists(x, y -> y is null or isnan(y) or abs(y) = double('infinity'))"
    )
    result = "vec_id long, v binary, length double"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            values = [np.floor(scale * np.array(x.as_py(), float)).astype(np.int64) for x in b.column(1)]
            lengths = pa.array([float(np.sqrt((v.astype(float) ** 2).sum())) for v in values], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in values], pa.binary()), lengths], schema=schema)

    return rows.mapInArrow(run, result)


def matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    """Vectors as rows, shorter ones filled up with zeros."""
    out = np.zeros((len(column), size), np.int64)
    for row, v in zip(out, column):
        own = np.frombuffer(v.as_buffer(), np.int64)
        row[: len(own)] = own
    return out


def rotation(vectors: DataFrame, size: int) -> np.ndarray:
    """Directions of the table, the strongest first, from the sum over all rows of their outer products."""
    result = "i int, j int, x double"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for b in source:
            own = matrix(b.column(0), size).astype(float)
            total += own.T @ own
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], schema=schema
        )

    total = np.zeros((size, size))
    for i, j, x in vectors.select("v").mapInArrow(run, result).groupBy("i", "j").agg(F.sum("x")).collect():
        total[i, j] = x
    return np.linalg.eigh(total)[1][:, ::-1].copy()


def _blocks(rows: DataFrame, per_block: int, order: list, name: str, folder: str) -> DataFrame:
    """``rows`` in blocks that follow the order and hold about ``per_block`` rows."""
    wanted = max(1, -(-rows.count() // per_block))
    return staged(rows.repartitionByRange(wanted, *order).withColumn(name, F.spark_partition_id()), f"{folder}/{name}")


def _edges(dealt: DataFrame, name: str, edge) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the blocks that hold rows, and one value of each."""
    rows = dealt.groupBy(name).agg(edge).orderBy(name).collect()
    return np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], float)


def _last_of(frame: DataFrame, column: str, numbers: np.ndarray, edges: np.ndarray, name: str) -> DataFrame:
    """``name``: the last of the blocks, by ascending edges, whose edge is not above the row's value; rows with none are left out."""
    result = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in frame.schema) + f", {name} int"
    schema = arrow_schema(result)
    place = frame.columns.index(column)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            count = np.searchsorted(edges, b.column(place).to_numpy(zero_copy_only=False), side="right")
            last = pa.array(np.where(count > 0, numbers[np.maximum(count, 1) - 1], -1), pa.int32())
            yield pa.RecordBatch.from_arrays([*b.columns, last], schema=schema).filter(pa.array(count > 0))

    return frame.mapInArrow(run, result)


def _every(last: str, name: str):
    return F.explode(F.sequence(F.lit(0), F.col(last))).alias(name)


class Best:
    """The k best candidates of each query so far, ties to the smaller id."""

    def __init__(self, n: int, k: int, last: np.ndarray | None = None) -> None:
        self.k, self.rows = k, np.zeros(0, np.int64)
        self.scores, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.last = np.full(n, -np.inf) if last is None else last.astype(float)

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        rows, scores, ids = (np.concatenate(p) for p in ((self.rows, rows), (self.scores, scores), (self.ids, ids)))
        order = np.lexsort((ids, -scores, rows))
        rows, scores, ids = rows[order], scores[order], ids[order]
        begins = np.searchsorted(rows, rows)
        keep = np.arange(len(rows)) - begins < self.k
        self.rows, self.scores, self.ids = rows[keep], scores[keep], ids[keep]
        counts = np.bincount(self.rows, minlength=len(self.last))
        full = np.flatnonzero(counts == self.k)
        ends = np.cumsum(counts)
        self.last[full] = np.maximum(self.last[full], self.scores[ends[full] - 1])


def search_block(
    queries: np.ndarray, own_rows: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int,
    rows: np.ndarray | None = None, last: np.ndarray | None = None,
) -> Best:
    """Best of one block for one block of queries, none with its own row; ``last``: scores that k others reach already."""
    best = Best(len(queries), k, last)
    vector_rows = ids if rows is None else rows
    if not len(queries) or not len(vectors):
        return best
    lengths = np.sqrt((vectors.astype(float) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    vectors, ids, lengths, vector_rows = vectors[order], ids[order], lengths[order], vector_rows[order]
    own = np.sqrt((queries.astype(float) ** 2).sum(1))
    turned = queries @ turn
    lead = min(LEADING, turned.shape[1])
    rest = np.sqrt((turned[:, lead:] ** 2).sum(1))
    for at in range(0, len(vectors), CHUNK):
        some = vectors[at : at + CHUNK]
        reach = own * lengths[at]
        live = np.flatnonzero(reach * (1 + SLACK) + 1e-6 >= best.last)
        if not len(live):
            break
        there = some @ turn
        bound = turned[live, :lead] @ there[:, :lead].T + np.outer(rest[live], np.sqrt((there[:, lead:] ** 2).sum(1)))
        bound += SLACK * np.outer(own[live], lengths[at : at + CHUNK]) + 1e-6
        rows, columns = np.nonzero((bound >= best.last[live, None]) & (vector_rows[at : at + CHUNK] != own_rows[live, None]))
        rows = live[rows]
        for a in range(0, len(rows), 1 << 14):
            r, c = rows[a : a + (1 << 14)], columns[a : a + (1 << 14)]
            scores = (queries[r] * some[c]).sum(1)
            good = scores >= best.last[r]
            best.add(r[good], scores[good], ids[at + c[good]])
    return best


def top_k(
    vectors: DataFrame, is_query, folder: str, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best rows for each query row, but for itself.

    ``is_query`` is a condition on ``vec_id``. Components become floor(scale * x); shorter vectors
    count as filled up with zeros. Every row counts, also one that repeats an id or a whole row, as a
    candidate and as a query with ranks of its own. Vectors that are missing or hold a missing or
    non-finite component, and rows without an id, take no part. Equal scores go to the smaller id.
    An empty table gives no rows. Scores must fit 64 bits.
    """
    rows = whole_numbers(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id())
    rows = staged(rows, f"{folder}/vectors")  # read from here on, so that a row's number stays
    size = (rows.agg(F.max(F.length("v"))).first()[0] or 0) // 8
    if not size:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    turn = rotation(rows, size)
    candidates = _blocks(rows, BLOCK, [F.desc("length"), F.col("row")], "block", folder)
    numbers, longest = _edges(candidates, "block", F.max("length"))
    result = "row long, query_id long, vec_id long, score long"
    schema = arrow_schema(result)

    def search(some: pa.Table, asked: pa.Table) -> pa.Table:
        own, ids = asked.column("row").to_numpy(), asked.column("vec_id").to_numpy()
        last = asked.column("last").to_numpy() if "last" in asked.column_names else None
        found, there = matrix(some.column("v"), size), some.column("vec_id").to_numpy()
        best = search_block(matrix(asked.column("v"), size), own, found, there, turn, k, some.column("row").to_numpy(), last)
        return pa.table([own[best.rows], ids[best.rows], best.ids, best.scores], schema=schema)

    queries = rows.filter(is_query)
    groups = max(1, -(-queries.count() // QUERY_BLOCK))
    asked = queries.withColumn("query_block", F.pmod(F.xxhash64("row"), F.lit(groups)).cast("int"))
    first = candidates.filter(F.col("block") == int(numbers[0])).withColumn("last_group", F.lit(groups - 1))
    first = first.select("row", "vec_id", "v", _every("last_group", "query_block"))
    seen = first.groupBy("query_block").cogroup(asked.groupBy("query_block")).applyInArrow(search, result)
    seen = staged(seen, f"{folder}/first")
    left, right = _pairs(candidates, _needing(queries, seen, k), numbers, longest, folder)
    cell = ["block", "query_block"]
    later = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(search, result)
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = seen.unionByName(later).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _needing(queries: DataFrame, seen: DataFrame, k: int) -> DataFrame:
    """Queries with ``last``, the k-th score seen, and ``need``, the least length of a vector that can still matter."""
    scores = seen.groupBy("row").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("least"))
    none = F.lit(float("-inf"))
    last = F.when(F.col("n") >= k, F.col("least")).otherwise(none)
    need = F.when((F.col("last") > 0) & (F.col("length") > 0), (F.col("last") - 1e-6) / (F.col("length") * (1 + 2 * SLACK)))
    return queries.join(scores, "row", "left").withColumn("last", last).withColumn("need", F.coalesce(need, none)).drop("n", "least")


def _pairs(
    candidates: DataFrame, queries: DataFrame, numbers: np.ndarray, longest: np.ndarray, folder: str
) -> tuple[DataFrame, DataFrame]:
    """Vectors of all blocks but the first and queries, each once for every pair of blocks in which it can matter."""
    asked = _blocks(queries, QUERY_BLOCK, [F.col("need"), F.col("row")], "query_block", folder)
    query_numbers, least = _edges(asked, "query_block", F.min("need"))
    there = candidates.filter(F.col("block") != int(numbers[0])).select("row", "vec_id", "v", "length", "block")
    left = _last_of(there, "length", query_numbers, least, "last_block").select("row", "vec_id", "v", "block", _every("last_block", "query_block"))
    # Blocks go from long to short: by their negated lengths they ascend.
    wanted = asked.select("row", "vec_id", "v", "last", "query_block", (-F.col("need")).alias("reach"))
    right = _last_of(wanted, "reach", numbers, -longest, "last_block").select("row", "vec_id", "v", "last", "query_block", _every("last_block", "block"))
    return left, right.filter(F.col("block") != int(numbers[0]))
