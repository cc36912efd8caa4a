"""Best-fit packing of documents into training sequences under several capacities at once.

Every task cuts its documents into pieces and packs them as they come, a bounded buffer at a
time. Bins that came out full stay; the pieces of the others are dealt anew into as many groups as
they fill buffers, mixed, and packed again, until they fit one buffer or mixing no longer lowers the
number of sequences. So no task gets more than its buffer, and only the poorly filled rest is ever
shuffled; pieces that cannot fill a bin together, whatever they are mixed with, are shuffled once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_schema, batches, narrowed, pairs, staged, type_of
from tidemark.llm.tokens import ID, encoder

#: A buffer holds so many tokens and pieces at most.
BUFFER_TOKENS, BUFFER_PIECES = 4_000_000, 16_000
#: A bin with this share of its tokens free, or less, is not packed again.
FULL = 1 / 512
#: A round that lowers the number of open bins by less than this share is the last one.
GAIN = 1 / 1000


def vector_best_fit(lengths: np.ndarray, capacities: tuple[int, int, int], rule: str = "norm") -> np.ndarray:
    """Bin of each piece, largest pieces first.

    A piece asks for (its tokens, one document, tokens squared as attention cost). Among the bins
    that can take it under every capacity it goes to the one whose residual is left smallest
    (``norm``) or lies most along the demand (``dot``), each dimension weighted by how scarce it is.
    A piece that no empty bin could take gets a bin of its own.
    """
    limits = np.array(capacities, float)
    wants = np.stack([lengths, np.ones_like(lengths), lengths.astype(float) ** 2], 1) / limits
    weights = wants.sum(0) / max(wants.sum(), 1e-12)
    order = np.argsort(-lengths, kind="stable")
    bins = np.empty(len(lengths), np.int64)
    left = np.empty((64, 3))
    names = np.empty(64, np.int64)
    used = made = 0
    # Residuals are whole numbers over the limits; half a unit absorbs the rounding.
    slack = 0.5 / limits
    smallest = wants.min(0) - slack if len(wants) else None
    for k in order:
        want = wants[k]
        free = left[:used]
        fits = (free >= want - slack).all(1)
        if fits.any():
            if rule == "norm":
                cost = ((free - want) ** 2) @ weights
            else:
                cost = -(free @ (weights * want)) / np.sqrt((free**2) @ weights + 1e-12)
            cost[~fits] = np.inf
            at = int(cost.argmin())
        else:
            if used == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            at, used = used, used + 1
            left[at], names[at], made = 1.0, made, made + 1
        bins[k] = names[at]
        left[at] -= want
        if (left[at] < smallest).any():  # it can take none of the pieces any more
            used -= 1
            left[at], names[at] = left[used], names[used]
    return bins


class Packer:
    """Packs pieces as they come; yields rows of the packed table."""

    def __init__(self, size: int, capacities: tuple[int, int, int], rule: str, base: int, last: bool, buffer: tuple[int, int]) -> None:
        self.size, self.capacities, self.rule, self.next, self.last, self.buffer = size, capacities, rule, base, last, buffer
        self.held: list[tuple] = []
        self.tokens = 0

    def add(self, piece: tuple) -> Iterator[tuple]:
        """``piece``: doc_id, piece, start, length, ids."""
        if piece[3] == self.size:
            yield (self.next, 0, *piece, False)
            self.next += 1
            return
        self.held.append(piece)
        self.tokens += piece[3]
        if self.tokens >= self.buffer[0] or len(self.held) >= self.buffer[1]:
            yield from self.flush()

    def flush(self) -> Iterator[tuple]:
        held, self.held, self.tokens = self.held, [], 0
        if not held:
            return
        lengths = np.array([p[3] for p in held], np.int64)
        bins = vector_best_fit(lengths, self.capacities, self.rule)
        filled = np.bincount(bins, lengths)
        again = (filled < self.size * (1 - FULL)) & (not self.last)
        at = -1
        for k in np.argsort(bins, kind="stable"):
            if bins[k] != at:
                at, offset = bins[k], 0
            yield (self.next + int(at), offset, *held[k], bool(again[at]))
            offset += held[k][3]
        self.next += len(filled)


def pieces(doc_id: object, ids: bytes, size: int) -> Iterator[tuple]:
    """Cuts ids into pieces of ``size``; the first takes what is left over."""
    total = len(ids) // ID.itemsize
    first = total % size or min(size, total)
    edges = [0, *range(first, total + 1, size)]
    for k, (a, b) in enumerate(zip(edges, edges[1:])):
        yield doc_id, k, a, b - a, ids[a * ID.itemsize : b * ID.itemsize]


def pack(
    docs: DataFrame,
    tokenizer: str,
    folder: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 2048,
    max_docs: int | None = None,
    max_attention: int | None = None,
    end_id: int = 0,
    rule: str = "norm",
) -> DataFrame:
    """Pieces of all documents, each with its sequence and its place there.

    Returns doc_id, piece, start, length, ids (binary, little-endian 32 bit), sequence_id, offset.
    No sequence holds more than ``size`` tokens, ``max_docs`` pieces (default ``size``) or a sum of
    squared piece lengths over ``max_attention`` (default ``size`` squared), except a piece that
    breaks a capacity alone: it has its own sequence. A missing text is empty and still has its end
    id; repeated rows and missing ids are packed like any others; other columns are ignored.
    """
    rows = narrowed(docs, id_col, text_col)
    capacities = (size, max_docs or size, max_attention or size * size)
    result = (
        f"sequence_id long, offset int, doc_id {type_of(rows, 'doc_id')}, piece int, start long, length long,"
        " ids binary, again boolean"
    )
    schema = arrow_schema(result)

    buffer = (BUFFER_TOKENS, BUFFER_PIECES)

    def packer(round_: int, last: bool) -> Packer:
        return Packer(size, capacities, rule, (round_ << 56) + (TaskContext.get().partitionId() << 32), last, buffer)

    def first_round(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            encode, end, own = encoder(tokenizer).ids, np.array([end_id], ID).tobytes(), packer(0, False)
            for doc_id, text in pairs(source):
                for piece in pieces(doc_id, encode(text) + end, size):
                    yield from own.add(piece)
            yield from own.flush()

        yield from batches(out(), schema)

    def later_round(round_: int, last: bool):
        def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def out() -> Iterator[tuple]:
                own = packer(round_, last)
                for b in source:
                    for row in b.to_pylist():
                        yield from own.add(tuple(row.values()))
                yield from own.flush()

            yield from batches(out(), schema)

        return run

    packed = staged(rows.mapInArrow(first_round, result), f"{folder}/round-0")
    done, open_, round_ = [packed.filter(~F.col("again"))], packed.filter("again"), 0
    while True:
        tokens, count, bins = open_.agg(
            F.coalesce(F.sum("length"), F.lit(0)), F.count(F.lit(1)), F.count_if(F.col("offset") == 0)
        ).first()
        if not count:
            break
        groups, round_ = max(1, math.ceil(tokens / BUFFER_TOKENS), math.ceil(count / BUFFER_PIECES)), round_ + 1
        again = open_.select("doc_id", "piece", "start", "length", "ids").repartition(groups)
        packed = staged(again.mapInArrow(later_round(round_, groups == 1), result), f"{folder}/round-{round_}")
        now = packed.filter("offset = 0").count()
        if now > bins:
            done.append(open_)
            break
        done.append(packed.filter(~F.col("again")))
        open_ = packed.filter("again")
        if now > bins * (1 - GAIN):
            done.append(open_)
            break
    return reduce(DataFrame.unionByName, done).select("doc_id", "piece", "start", "length", "ids", "sequence_id", "offset")
