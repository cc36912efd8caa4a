"""Small helpers that the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

ROWS, BYTES = 4000, 16_000_000


def staged(frame: DataFrame, path: str, codec: str = "zstd") -> DataFrame:
    """``frame`` as written to ``path``: later steps read the files and compute nothing anew."""
    frame.write.option("compression", codec).mode("overwrite").parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def narrowed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, named ``doc_id`` and ``text`` whatever else the table holds."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


def type_of(frame: DataFrame, column: str) -> str:
    return frame.schema[column].dataType.simpleString()


def batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 64) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size; ``size`` is the bytes of a row without its binaries."""
    held: list[tuple] = []
    count = 0
    for row in rows:
        held.append(row)
        count += size + sum(len(x) for x in row if isinstance(x, (bytes, str)))
        if len(held) >= ROWS or count >= BYTES:
            yield batch(held, schema)
            held, count = [], 0
    if held:
        yield batch(held, schema)


def batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def pairs(source: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """The first two values of every row, one at a time so that few texts are held as Python objects."""
    for b in source:
        yield from ((x.as_py(), y.as_py()) for x, y in zip(b.column(0), b.column(1)))


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """The shared store that a folder lies in, as ``pyarrow`` knows it, and the path there."""
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:/") else f"file://{uri}")


def whole_keys(source: Iterable[pa.RecordBatch], size: int = 0) -> Iterator[pa.Table]:
    """Tables of whole keys (the first column; rows come sorted by it), of ``size`` bytes or more but for the last."""
    held: list[pa.RecordBatch] = []
    count = 0
    for b in source:
        held.append(b)
        count += b.nbytes
        if count < max(1, size):
            continue
        table = pa.Table.from_batches(held)
        ends = np.flatnonzero(pc.not_equal(table.column(0)[1:], table.column(0)[:-1]).to_numpy(zero_copy_only=False))
        if len(ends):
            yield table.slice(0, int(ends[-1]) + 1)
            table = table.slice(int(ends[-1]) + 1)
            held, count = table.to_batches(), table.nbytes
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def mapped(frame: DataFrame, run: Callable[[Iterator[pa.RecordBatch], pa.Schema], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """``frame`` through ``run``, which gets its batches and the schema of the result."""
    schema = arrow_schema(ddl)
    return frame.mapInArrow(lambda source: run(source, schema), ddl)
