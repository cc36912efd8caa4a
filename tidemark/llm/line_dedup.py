"""Lines that several documents share, kept in the first of them only.

Pass one reduces the lines to (128-bit hash, smallest and largest document) with partial sums in
every task, so a line on a third of all documents is one row per task. Hashes that two documents
share are dealt into shards of bounded size. Each shard becomes one file: a minimal perfect hash
and, by its numbers, arrays of fingerprints, document counts and first documents. Pass two reads
the documents again and probes those files a batch at a time, shard by shard: no line is joined,
no document is shuffled. A task holds one shard at a time besides the few it remembers, whatever
the size of the whole index; what grows is reading, by the index once for each batch of documents.
"""

from __future__ import annotations

import io
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_schema, batches, narrowed, pairs, staged, store, type_of
from tidemark.llm.perfect_hash import PerfectHash

MIN_CHARS = 10
#: Keys in a shard, on average; shards a task remembers.
SHARD_KEYS, REMEMBERED = 200_000, 4
#: Stands for a missing id: a document of its own, after all others.
NO_ID = (1 << 63) - 1


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """Hash of the line's key, None if the key is too short to count."""
    key = line.strip().lower()
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode()) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def split_keys(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return both[:, 0], both[:, 1]


def _hash_lines(min_chars: int, schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for doc_id, text in pairs(source):
                own = {line_key(line, min_chars) for line in (text or "").encode().split(b"\n")} - {None}
                doc = NO_ID if doc_id is None else doc_id
                for key in own:
                    yield int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True), doc

        yield from batches(rows(), schema, 24)

    return run


class Shard:
    """Perfect hash and arrays of one shard."""

    def __init__(self, high: np.ndarray, low: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> None:
        self.hash = PerfectHash.of(high, low)
        at = self.hash.numbers(high, low)
        width = np.min_scalar_type(int(counts.max(initial=0)))
        self.prints, self.counts, self.firsts = np.empty_like(low), np.empty(len(low), width), np.empty_like(firsts)
        self.prints[at], self.counts[at], self.firsts[at] = low, counts, firsts

    def save(self, uri: str) -> None:
        files, path = store(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        buffer = io.BytesIO()
        np.savez(
            buffer, sizes=np.array(self.hash.sizes, np.int64), bits=self.hash.bits,
            prints=self.prints, counts=self.counts, firsts=self.firsts,
        )
        with files.open_output_stream(path) as out:
            out.write(buffer.getvalue())

    @classmethod
    def load(cls, uri: str) -> Shard:
        files, path = store(uri)
        with files.open_input_file(path) as source:
            held = np.load(io.BytesIO(source.read()))
        self = cls.__new__(cls)
        self.hash = PerfectHash(held["sizes"].tolist(), held["bits"])
        self.prints, self.counts, self.firsts = held["prints"], held["counts"], held["firsts"]
        return self

    def first(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """First document of each key; ``NO_ID`` less one for a key that no two documents share."""
        at = self.hash.numbers(high, low)
        known = at >= 0
        known[known] = self.prints[at[known]] == low[known]
        found = np.full(len(high), NO_ID - 1, np.int64)
        found[known] = self.firsts[at[known]]
        return found


def build_index(docs: DataFrame, folder: str, min_chars: int = MIN_CHARS) -> list[str]:
    """Writes the shards of the lines that two documents or more share; returns their files by number.

    The list names one file per shard, so it grows by a name for every ``SHARD_KEYS`` shared lines.
    """
    lines = docs.mapInArrow(_hash_lines(min_chars, arrow_schema("high long, low long, doc long")), "high long, low long, doc long")
    shared = staged(
        lines.groupBy("high", "low")
        .agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("n_docs"))
        .filter("first != last")
        .drop("last"),
        f"{folder}/shared",
    )
    shards = max(1, round(shared.count() / SHARD_KEYS))
    result = "shard int, name string"

    def build(table: pa.Table) -> pa.Table:
        high, low = (table.column(c).to_numpy().astype(np.int64).view(np.uint64) for c in ("high", "low"))
        name = f"{uuid.uuid4().hex}.npz"
        Shard(high, low, table.column("n_docs").to_numpy(), table.column("first").to_numpy()).save(f"{folder}/shards/{name}")
        return pa.table({"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "name": [name]})

    named = staged(
        shared.withColumn("shard", F.pmod("high", F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, result),
        f"{folder}/names",
    )
    names = dict(named.collect())
    return [names.get(k, "") for k in range(shards)]


class Prober:
    """Which lines of a batch of texts go."""

    def __init__(self, folder: str, names: list[str], min_chars: int) -> None:
        self.folder, self.names, self.min_chars = folder, names, min_chars
        self.held: OrderedDict[int, Shard] = OrderedDict()

    def shard(self, k: int) -> Shard | None:
        if k not in self.held and self.names[k]:
            while len(self.held) >= REMEMBERED:
                self.held.popitem(last=False)
            self.held[k] = Shard.load(f"{self.folder}/shards/{self.names[k]}")
        return self.held.get(k)

    def cleaned(self, ids: list, texts: list) -> Iterator[tuple[int, int, bytes]]:
        """Lines, dropped lines and the text left, for each document of the batch."""
        hashes, places, starts = [], [], [0]
        split = [(t or "").encode().split(b"\n") for t in texts]
        for lines in split:
            for k, line in enumerate(lines, starts[-1]):
                key = line_key(line, self.min_chars)
                if key is not None:
                    hashes.append(key)
                    places.append(k)
            starts.append(starts[-1] + len(lines))
        gone = np.zeros(starts[-1], bool)
        if hashes:
            high, low = split_keys(hashes)
            at = np.array(places)
            own = np.repeat(np.array([NO_ID if i is None else i for i in ids], np.int64), [len(x) for x in split])[at]
            number = high.view(np.int64) % len(self.names)
            order = np.argsort(number, kind="stable")
            edges = np.searchsorted(number[order], np.arange(len(self.names) + 1))
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                shard = self.shard(k) if b > a else None
                if shard:
                    some = order[a:b]
                    first = shard.first(high[some], low[some])
                    gone[at[some]] = (first != NO_ID - 1) & (first != own[some])
        for lines, start in zip(split, starts):
            drop = gone[start : start + len(lines)]
            n = int(drop.sum())
            yield len(lines), n, b"\n".join(x for x, d in zip(lines, drop.tolist()) if not d) if n else b"\n".join(lines)


def dedup_lines(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped and the text left.

    Ids are integers. A missing text is one empty line; a missing id is a document of its own after
    all others, rows that repeat an id are one document. Other columns are ignored.
    """
    rows = narrowed(docs, id_col, text_col)
    names = build_index(rows, folder, min_chars)
    result = f"doc_id {type_of(rows, 'doc_id')}, n_lines long, n_dropped long, text string"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(folder, names, min_chars)
        for b in source:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            cleaned = prober.cleaned(ids, texts)
            yield from batches(((i, n, d, t.decode()) for i, (n, d, t) in zip(ids, cleaned)), schema)

    return rows.mapInArrow(run, result)


def without_shared_lines(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with all columns, less the lines that an earlier document holds; a missing text stays missing."""
    names = build_index(narrowed(docs, id_col, text_col), folder, min_chars)
    key, place = docs.columns.index(id_col), docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prober = Prober(folder, names, min_chars)
        for b in source:
            texts = b.column(place).to_pylist()
            left = [x if x is None else t.decode() for x, (_, _, t) in zip(texts, prober.cleaned(b.column(key).to_pylist(), texts))]
            yield b.set_column(place, b.schema.field(place), pa.array(left, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)
