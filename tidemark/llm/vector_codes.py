"""Product codes of vectors by exact integer k-means, on limb-split matrix products.

Components become whole numbers and vectors are cut into equal parts. The distances of all vectors
of a batch to all entries of a part's codebook need one matrix product. Integers are broken into
limbs so short that every sum a float64 product makes stays below 2^53 and so is exact; products of
limbs are shifted into place and added as 64-bit integers, and the first smallest distance wins.
The sums of a round are added up over the tasks; a codebook of some hundred numbers is all that
travels between rounds.

Numbers too large for a 64-bit distance take the same steps as Python's unbounded integers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_schema, staged, type_of

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Whole numbers that float64 holds without loss, in bits; bits of a limb of a sum that travels.
EXACT, SUM_LIMB = 53, 60
#: Vectors in one matrix product.
ROWS = 4096
MOST = (1 << 63) - 1
SUMS = "part int, entry int, place int, limb int, total decimal(38,0), n long"

#: Entries by part: whole numbers by entry and place.
Books = list[list[list[int]]]


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """float64 arrays whose sum, each shifted by ``bits`` more than the one before, is ``x``."""
    out = []
    while x.size and (np.abs(x) >> bits).any():
        out.append((x & ((1 << bits) - 1)).astype(float))
        x = x >> bits
    return [*out, x.astype(float)]


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of the rows of two 64-bit integer matrices, modulo 2^64."""
    bits = (EXACT - max(1, a.shape[1]).bit_length()) // 2
    out = np.zeros((len(a), len(b)), np.int64)
    for j, x in enumerate(limbs(a, bits)):
        for k, y in enumerate(limbs(b, bits)):
            if bits * (j + k) < 64:
                out += (x @ y.T).astype(np.int64) << (bits * (j + k))
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of two 64-bit integer matrices; they must fit 64 bits, what leads to them need not."""
    with np.errstate(over="ignore"):
        return (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * dot_products(a, b)


def largest(width: int) -> int:
    """Numbers of at most this size have squared distances over so many places that fit 64 bits."""
    return math.isqrt(MOST // max(1, width)) // 2


def scaled(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    numerator, denominator = x.as_integer_ratio()
    return scale * numerator // denominator


class Coder:
    """Nearest entries of one batch after another."""

    def __init__(self, books: Books, width: int, scale: int) -> None:
        self.books, self.width, self.scale = books, width, scale
        self.most = largest(width)
        self.fits = all(abs(v) <= self.most for book in books for entry in book for v in entry)
        self.arrays = [np.array(book, np.int64).reshape(len(book), width) for book in books] if self.fits else []

    def batch(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | list, np.ndarray, np.ndarray]]:
        """(rows, numbers, nearest entry by part, distance by part) of the rows with 64-bit distances and of each other row."""
        size = self.width * len(self.books)
        values = np.zeros((len(column), size))
        lengths = np.diff(column.offsets.to_numpy())
        inside = np.arange(size)[None] < lengths[:, None]
        values[inside] = column.flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            numbers = np.floor(values * self.scale)
        small = (np.abs(numbers) <= self.most).all(1) & self.fits & (self.scale < 1 << 20)
        rows = np.flatnonzero(small)
        for at in range(0, len(rows), ROWS):
            some = rows[at : at + ROWS]
            whole = numbers[some].astype(np.int64)
            code = np.zeros((len(some), len(self.books)), np.int64)
            error = np.zeros((len(some), len(self.books)), np.int64)
            for p, book in enumerate(self.arrays):
                found = distances(whole[:, p * self.width : (p + 1) * self.width], book)
                code[:, p] = found.argmin(1)
                error[:, p] = found[np.arange(len(some)), code[:, p]]
            yield some, whole, code, error
        for row in np.flatnonzero(~small):
            whole = [scaled(x, self.scale) for x in values[row].tolist()]
            code, error = [], []
            for p, book in enumerate(self.books):
                own = whole[p * self.width : (p + 1) * self.width]
                found = [sum((x - y) ** 2 for x, y in zip(own, entry)) for entry in book]
                error.append(min(found))
                code.append(found.index(error[-1]))
            yield np.array([row]), [whole], np.array([code]), np.array([error], object)


def _sums(coder: Coder, schema: pa.Schema):
    """Sums and counts of the numbers nearest to each entry, one set per task."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, width = len(coder.books), coder.width
        entries = len(coder.books[0])
        totals = np.zeros((parts, entries, width), object)
        counts = np.zeros((parts, entries), np.int64)
        for b in source:
            for _, whole, code, _ in coder.batch(b.column(0)):
                for p in range(parts):
                    own = np.array(whole, object if isinstance(whole, list) else np.int64)[:, p * width : (p + 1) * width]
                    counts[p] += np.bincount(code[:, p], minlength=entries)
                    some = np.zeros((entries, width), own.dtype)
                    np.add.at(some, code[:, p], own)
                    totals[p] += some
        rows = []
        for p, e in zip(*np.nonzero(counts)):
            rows.append((p, e, -1, 0, 0, counts[p, e]))
            for place in range(width):
                limb, total = 0, int(totals[p, e, place])
                while not -(1 << SUM_LIMB) <= total < 1 << SUM_LIMB:
                    rows.append((p, e, place, limb, total & ((1 << SUM_LIMB) - 1), 0))
                    limb, total = limb + 1, total >> SUM_LIMB
                rows.append((p, e, place, limb, total, 0))
        columns = list(zip(*rows)) or [()] * len(schema)
        arrays = [pa.array([int(x) for x in c], pa.int64()).cast(f.type) for c, f in zip(columns, schema)]
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return run


def _moved(books: Books, rows: DataFrame, width: int, scale: int) -> Books:
    """Entries as the floored means of what is nearest to them; unused ones stay."""
    sums = rows.select("x").mapInArrow(_sums(Coder(books, width, scale), arrow_schema(SUMS)), SUMS)
    total: dict[tuple, int] = {}
    count: dict[tuple, int] = {}
    for p, e, place, limb, value, n in sums.groupBy("part", "entry", "place", "limb").agg(F.sum("total"), F.sum("n")).collect():
        if place < 0:
            count[p, e] = n
        else:
            total[p, e, place] = total.get((p, e, place), 0) + (int(value) << (SUM_LIMB * limb))
    return [
        [[total[p, e, k] // count[p, e] for k in range(width)] if (p, e) in count else entry for e, entry in enumerate(book)]
        for p, book in enumerate(books)
    ]


def books_sha256(books: Books) -> str:
    """SHA-256 of all numbers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()


def _coded(coder: Coder, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            codes: list = [None] * b.num_rows
            errors: list = [None] * b.num_rows
            for rows, _, code, error in coder.batch(b.column(2)):
                for row, own, e in zip(rows.tolist(), code.astype(np.uint16), error):
                    total = sum(int(v) for v in e)
                    codes[row], errors[row] = own.astype(np.uint8).tobytes(), total if total <= MOST else None
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.binary()), pa.array(errors, pa.int64())], schema=schema)

    return run


def encode(
    vectors: DataFrame, folder: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
    id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
) -> tuple[DataFrame, Books]:
    """Vectors as codes, and the codebooks: vec_id, label, ``code`` (a byte per part), error (squared
    distances to the entries), label_error (errors summed over equal labels, missing ones together).

    A component x becomes floor(scale * x). Codebooks start as the vectors of the ``entries`` (256 at most)
    smallest ids, fewer if there are fewer; missing ids are the largest, equal ones go by their vector.
    Vectors that are missing or hold a missing or non-finite component are left out. Shorter vectors
    count as filled up with zeros, to a multiple of ``parts``. Repeated rows all count. An error beyond 64
    bits is null, as is a sum of them, which passes over null ones. An empty table gives no rows.
    """
    numbers = F.transform(F.col(f"`{vector_col}`"), lambda x: x.cast("double"))
    given = vectors.select(F.col(f"`{id_col}`").alias("vec_id"), F.col(f"`{label_col}`").alias("label"), numbers.alias("x"))
    rows = staged(
        given.filter("x is not null and not exists(x, y -> y is null or isnan(y) or abs(y) = double('infinity'))"), f"{folder}/vectors"
    )
    seeds = rows.orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).select("x").collect()
    if not seeds:
        empty = f"vec_id {type_of(rows, 'vec_id')}, label {type_of(rows, 'label')}, code binary, error long, label_error long"
        return vectors.sparkSession.createDataFrame([], empty), []
    width = -(-rows.agg(F.max(F.size("x"))).first()[0] // parts)
    first = [[scaled(x, scale) for x in r.x] + [0] * (parts * width - len(r.x)) for r in seeds]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(parts)]
    for _ in range(rounds):
        books = _moved(books, rows, width, scale)
    result = f"vec_id {type_of(rows, 'vec_id')}, label {type_of(rows, 'label')}, code binary, error long"
    coded = staged(rows.select("vec_id", "label", "x").mapInArrow(_coded(Coder(books, width, scale), arrow_schema(result)), result), f"{folder}/coded")
    sums = coded.groupBy("label").agg(F.expr("try_cast(sum(cast(error as decimal(38, 0))) as bigint)").alias("label_error"))
    sums = sums.withColumnRenamed("label", "l")
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("l")))
    return joined.select("vec_id", "label", "code", "error", "label_error"), books
