"""SimHash near-duplicates, found by covering locality-sensitive hashing.

Every bit of a fingerprint has a code of three bits, every table one of the seven masks that
such codes allow: a bit is in the mask if code and mask have an odd number of ones in common.
Two bits that differ leave a mask that holds neither, so any two fingerprints at most two bits
apart agree under some mask and meet in that table, without fail.

Only distinct fingerprints are dealt out. A bucket with more than ``BUCKET`` of them is dealt out
again by the same masks over its free bits, which leaves at most twelve bits free: no bucket can
then hold more than 4096 fingerprints. A bucket yields the edges of its own components, a tree
each, never all pairs; the trees are joined to components by ``components.roots``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import components
from tidemark.llm.frames import arrow_schema, batches, narrowed, staged, type_of

BITS, RADIUS, TABLES, SEED = 64, 2, 7, 42
BUCKET = 2048


def masks(bits: list[int]) -> list[int]:
    """Masks over these bits; any two bits are both left out of one of them."""
    codes = {b: 1 + k % TABLES for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (codes[b] & v).bit_count() % 2) for v in range(1, TABLES + 1)]


FIRST = masks(list(range(BITS)))
SECOND = [masks([b for b in range(BITS) if not m >> b & 1]) for m in FIRST]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: str | None, words_in_shingle: int = 3) -> int:
    """Bitwise majority of the shingles' hashes, as a signed integer; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    begins = ends - lengths
    n = max(1, len(words) - words_in_shingle + 1)
    last = ends[-1:] if len(words) < words_in_shingle else ends[words_in_shingle - 1 :]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    first, last = begins[:n].tolist(), last.tolist()
    for k in range(0, n, 1 << 14):
        some = [digest(joined[a:b], SEED) for a, b in zip(first[k : k + (1 << 14)], last[k : k + (1 << 14)])]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(0, dtype=np.int32)
    return int(np.packbits(2 * counts > n).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text) and ``fp`` (long) of every row."""
    rows = narrowed(docs, id_col, text_col).withColumn("h", F.xxhash64("text"))
    result = f"doc_id {type_of(rows, 'doc_id')}, h long, fp long"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in source:
            found = [fingerprint(x.as_py(), words_in_shingle) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(found, pa.int64())], schema=schema)

    return rows.mapInArrow(run, result)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits that differ; counted without sign."""
    return np.bitwise_count((a ^ b).view(np.uint64))


def _trees(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """An edge from every fingerprint of the bucket to another of its component, but for one of each component."""
    near = np.empty((len(prints), len(prints)), bool)
    for k in range(0, len(prints), 256):
        near[k : k + 256] = apart(prints[k : k + 256, None], prints[None]) <= RADIUS
    open_ = np.ones(len(prints), bool)
    for root in range(len(prints)):
        if not open_[root]:
            continue
        open_[root] = False
        front = np.array([root])
        while len(front):
            found = near[front].any(0) & open_
            open_[found] = False
            front = np.flatnonzero(found)
            yield from ((int(prints[x]), int(prints[root])) for x in front)


BUCKET_KEY = ["t", "key", "t2", "key2"]


def _bucket_edges(schema: pa.Schema):
    """Edges of the buckets; the rows come sorted by bucket, so only the last one of a batch is held over."""

    def buckets(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        keys = np.stack([table.column(c).to_numpy().astype(np.int64) for c in BUCKET_KEY])
        return table.column("fp").to_numpy().astype(np.int64), np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1

    def edges(prints: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        two = begins[ends - begins == 2]
        near = apart(prints[two], prints[two + 1]) <= RADIUS
        yield from zip(prints[two + 1][near].tolist(), prints[two][near].tolist())
        for k in np.flatnonzero(ends - begins > 2):
            yield from _trees(prints[begins[k] : ends[k]])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[int, int]]:
            rest: pa.Table | None = None
            for b in source:
                table = pa.Table.from_batches([b])
                table = pa.concat_tables([rest, table]) if rest is not None else table
                prints, ends = buckets(table)
                begins = np.concatenate([[0], ends]).astype(np.int64)
                yield from edges(prints, begins[:-1], ends)
                rest = table.slice(int(begins[-1]))
            if rest is not None and rest.num_rows:
                prints, _ = buckets(rest)
                yield from edges(prints, np.array([0]), np.array([len(prints)]))

        yield from batches(rows(), schema, 16)

    return run


def _under(all_masks: list[int], t: str, key: str):
    """The bits of ``fp`` under each mask, as an array of (number of the mask, bits)."""
    return F.array(
        *(F.struct(F.lit(k).alias(t), F.col("fp").bitwiseAND(F.lit(signed(m))).alias(key)) for k, m in enumerate(all_masks))
    )


def links(prints: DataFrame, folder: str) -> DataFrame:
    """Edges ``a``, ``b`` that join any two of the distinct fingerprints ``fp`` at most two bits apart."""
    dealt = prints.select("fp", F.inline(_under(FIRST, "t", "key")))
    shared = dealt.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = staged(dealt.join(shared, ["t", "key"]), f"{folder}/met")
    few = met.filter(F.col("n") <= BUCKET).select("fp", "t", "key", F.lit(-1).alias("t2"), F.lit(0).cast("long").alias("key2"))
    inner = F.element_at(F.array(*(_under(m, "t2", "key2") for m in SECOND)), F.col("t") + 1)
    many = met.filter(F.col("n") > BUCKET).select("fp", "t", "key", F.inline(inner))
    buckets = few.unionByName(many).repartition(*BUCKET_KEY).sortWithinPartitions(*BUCKET_KEY)
    return buckets.mapInArrow(_bucket_edges(arrow_schema("a long, b long")), "a long, b long")


def _classes(own: DataFrame, folder: str) -> DataFrame:
    """``fp`` of every row of ``own`` once, with ``least``: the first row of its component."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "h"))
    prints = staged(own.groupBy("fp").agg(first.alias("least")), f"{folder}/distinct")
    tied = components.roots(links(prints, folder), f"{folder}/components").select(F.col("a").alias("fp"), F.col("b").alias("root"))
    members = tied.unionByName(tied.select(F.col("root").alias("fp"), "root").distinct()).join(prints, "fp")
    first = members.groupBy("root").agg(F.min("least").alias("first"))
    named = members.join(first, "root").select("fp", "first")
    return prints.join(named, "fp", "left").select("fp", F.coalesce("first", "least").alias("least"))


def near_duplicates(
    docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3
) -> DataFrame:
    """One row per document: doc_id, ``fp`` (long) and component_id, the smallest id that its links reach.

    A missing text has no words, so fingerprint 0 like an empty one. Repeated rows each give a row.
    A missing id is never the smallest; a component without any id has none. Other columns are ignored.
    """
    own = staged(fingerprints(docs, id_col, text_col, words_in_shingle), f"{folder}/fingerprints")
    return own.join(_classes(own, folder), "fp").select("doc_id", "fp", F.col("least.doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, one row of each component: that of the smallest id.

    Rows without an id come last. Among rows that repeat an id and a text any one stays, always the same.
    """
    own = staged(fingerprints(docs, id_col, text_col), f"{folder}/fingerprints")
    first = _classes(own, folder).select(F.col("least.doc_id").alias("i"), F.col("least.h").alias("h")).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text, key = F.xxhash64(F.col("row")[text_col]), F.col("row")[id_col]
    kept = rows.join(first, key.eqNullSafe(F.col("i")) & (text == F.col("h")), "left_semi")
    order = Window.partitionBy(key, text).orderBy(F.xxhash64(F.struct("row")))
    return kept.withColumn("n", F.row_number().over(order)).filter("n = 1").select("row.*")
