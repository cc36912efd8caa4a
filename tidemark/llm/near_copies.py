"""Near copies by SimHash tables for a wider radius, decided by the exact likeness of word shingles.

Two texts that share four fifths of their five-word shingles differ in some ten bits of one SimHash of
these shingles, too many for covering tables. So the prints here count what an edit hardly touches, words
and pairs of words, and there are several: a pair is a candidate if it is within ``RADIUS`` bits in any of
``PRINTS`` prints, which the masks guarantee to find. Candidates only have to be plenty enough;
whether two texts are near copies is decided by their shingles.

1. Every text gets its prints; equal texts go on as one, as do texts with equal prints.
2. A print goes to one bucket for every mask. A bucket with more than ``BUCKET`` different prints is
   dealt out again by masks over its free bits. It yields a tree over the prints near each other,
   never all pairs, and its members for step 4.
3. For each text the edge to the middle of its group is decided first, since that is most like all
   others; the trees' edges only where that has not already put both ends into one group.
4. What remains are members of one bucket in different groups: those pairs are decided as well, so no
   pair of candidates that could join two groups is left out.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm import components
from tidemark.llm.frames import batches, mapped, staged
from tidemark.llm.perfect_hash import mixed
from tidemark.llm.simhash import BITS, signed

#: Words of a shingle, and the share of them that near copies have in common.
SHINGLE, SIMILAR = 5, 0.8
#: Prints of a text, bits that near ones differ in at most, and how often a word counts at most.
PRINTS, RADIUS, COUNTED = 5, 3, 8
#: Different prints of a bucket that are compared with each other.
BUCKET = 2048
SEED = 42
NO_ID = (1 << 63) - 1
TEXT = "doc long, name binary, prints binary"
ENTRY = "key long, print long, node long, free long"
#: kind 0: an edge between nodes a > b; 1: node a with print b is a member of bucket key; 2: an entry to be dealt out again;
#: 3: b is the middle of node a's group.
FOUND = "kind int, key long, a long, b long, free long"


def covering(bits: list[int], radius: int) -> list[int]:
    """Masks over these bits, one of which leaves out any ``radius`` of them.

    Bits have codes of radius + 1 binary digits, a mask holds those whose code has an odd number of ones
    in common with its own: for any ``radius`` codes there is a mask that is even to all of them.
    """
    tables = (1 << (radius + 1)) - 1
    codes = {b: 1 + k % tables for k, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (codes[b] & v).bit_count() % 2) for v in range(1, tables + 1)]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def shingles(text: str | None, size: int = SHINGLE) -> set[bytes]:
    """Word shingles, A-Z in lower case; the whole sequence if it is shorter, none without words."""
    words = words_of(text)
    return {b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def alike(a: str | None, b: str | None) -> bool:
    one, two = shingles(a), shingles(b)
    both = len(one & two)
    return both >= SIMILAR * (len(one) + len(two) - both) - 1e-9


def prints_of(text: str | None) -> np.ndarray:
    """Weighted bitwise majorities over words and pairs of words, a different hash for each print."""
    words = words_of(text)
    if not words:
        return np.zeros(PRINTS, np.uint64)
    counts = Counter(words)
    weights = [min(n, COUNTED) for n in counts.values()]
    features = [*counts, *(a + b" " + b for a, b in zip(words, words[1:]))]
    hashes = np.array([xxhash.xxh64_intdigest(f, SEED) for f in features], np.uint64)
    weight = np.ones(len(features), np.int32)
    weight[: len(weights)] = weights
    out = np.zeros(PRINTS, np.uint64)
    for k in range(PRINTS):
        total = np.zeros(BITS, np.int64)
        for at in range(0, len(hashes), 1 << 14):
            bits = np.unpackbits(mixed(hashes[at : at + (1 << 14)], k).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            total += weight[at : at + (1 << 14)] @ bits
        out[k] = np.packbits(2 * total > weight.sum()).view(">u8")[0]
    return out


def _prints(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for b in source:
            for doc, name, text in zip(*b.columns):
                yield doc.as_py(), name.as_py(), prints_of(text.as_py()).tobytes()

    yield from batches(rows(), schema)


def _entries(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """A row for every print and mask: the bits under the mask, told apart by print and mask."""
    masks = covering(list(range(BITS)), RADIUS)
    for b in source:
        prints = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint64).reshape(-1, PRINTS)
        nodes = b.column(0).to_numpy()
        for k in range(PRINTS):
            for m, mask in enumerate(masks):
                key = mixed(prints[:, k] & np.uint64(mask), k * len(masks) + m).view(np.int64)
                free = np.full(len(nodes), signed(~mask & ((1 << BITS) - 1)), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key, prints[:, k].view(np.int64), nodes, free)], schema=schema)


def _dealt_again(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Entries of large buckets by masks over the bits that their bucket leaves free."""

    def rows() -> Iterator[tuple]:
        cover: dict[int, list[int]] = {}
        for b in source:
            for key, print_, node, free in zip(*(c.to_pylist() for c in b.columns)):
                if free not in cover:
                    cover[free] = covering([k for k in range(BITS) if free >> k & 1], RADIUS)
                for m, mask in enumerate(cover[free]):
                    bits = xxhash.xxh64_intdigest((print_ & mask & ((1 << BITS) - 1)).to_bytes(8, "little") + key.to_bytes(8, "little", signed=True), m)
                    yield signed(bits), print_, node, signed(free & ~mask & ((1 << BITS) - 1))

    yield from batches(rows(), schema, 32)


def near_groups(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Groups of two or more prints that are near each other, by place: the prints, for each the near one
    that it was found by (itself for the first), and the middle one, that of the least distances to all others."""
    apart = np.empty((len(prints), len(prints)), np.uint8)
    for k in range(0, len(prints), 256):
        apart[k : k + 256] = np.bitwise_count(prints[k : k + 256, None] ^ prints[None])
    open_ = np.ones(len(prints), bool)
    for root in range(len(prints)):
        if not open_[root]:
            continue
        open_[root] = False
        members, by, front = [np.array([root])], [np.array([root])], np.array([root])
        while len(front):
            found = (apart[front] <= RADIUS) & open_
            new = np.flatnonzero(found.any(0))
            open_[new] = False
            members.append(new)
            by.append(front[found[:, new].argmax(0)] if len(new) else new)
            front = new
        whole = np.concatenate(members)
        if len(whole) > 1:
            yield whole, np.concatenate(by), int(whole[apart[np.ix_(whole, whole)].sum(1, dtype=np.int64).argmin()])


def _close(source: Iterator[pa.RecordBatch], schema: pa.Schema, bucket: int) -> Iterator[pa.RecordBatch]:
    """Edges and members of the buckets, whose entries come sorted by key, print and node."""

    def closed(key: int, held: list[tuple[int, int]], free: int, members: int) -> Iterator[tuple]:
        """``held``: different prints, each with its first node."""
        if len(held) > bucket:
            yield from ((2, key, node, print_, free) for print_, node in held)
            return
        if len(held) < 2:
            return
        prints = np.array([h[0] for h in held], np.int64).view(np.uint64)
        for group, by, middle in near_groups(prints):
            for x, found_by in zip(group.tolist(), by.tolist()):
                a, b, m = held[x][1], held[found_by][1], held[middle][1]
                if a != b:
                    yield 0, key, max(a, b), min(a, b), 0
                if a != m:
                    yield 3, key, a, m, 0
                if members > 2:
                    yield 1, key, a, held[x][0], free

    def rows() -> Iterator[tuple]:
        last, held, free, members = None, [], 0, 0
        for b in source:
            for key, print_, node, f in zip(*(c.to_numpy().tolist() for c in b.columns)):
                if key != last:
                    if members > 1:
                        yield from closed(last, held, free, members)
                    last, held, free, members = key, [(print_, node)], f, 1
                    continue
                members += 1
                if print_ == held[-1][0]:  # equal prints: an edge to the first, and members of the bucket
                    if node != held[-1][1]:
                        yield 0, key, max(node, held[-1][1]), min(node, held[-1][1]), 0
                        yield 1, key, node, print_, free
                        yield 1, key, held[-1][1], print_, free
                    continue
                if len(held) > 2 * bucket:  # goes on to the next dealing at once, so that no bucket is held
                    yield from ((2, key, n, p, f) for p, n in held[:bucket])
                    held = held[bucket:]
                held.append((print_, node))
        if members > 1:
            yield from closed(last, held, free, members)

    yield from batches(rows(), schema, 36)


def _alike(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in source:
        keep = [alike(x.as_py(), y.as_py()) for x, y in zip(b.column(2), b.column(3))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], schema=schema).filter(pa.array(keep, pa.bool_()))


def _candidates(texts: DataFrame, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Edges ``a`` > ``b`` between texts with near prints, the one of each text to what is most often the middle of
    its group, and members of buckets: ``key``, ``a``, ``print``, ``free``."""
    entries = mapped(texts, _entries, ENTRY)
    edges, members, middles = [], [], []
    for level in range(BITS):
        dealt = entries.repartition("key").sortWithinPartitions("key", "print", "node")
        found = staged(mapped(dealt, partial(_close, bucket=BUCKET), FOUND), f"{folder}/close-{level}")
        edges.append(found.filter("kind = 0").select("a", "b"))
        middles.append(found.filter("kind = 3").select("a", "b"))
        members.append(found.filter("kind = 1").select("key", "a", F.col("b").alias("print"), "free"))
        large = found.filter("kind = 2").select("key", F.col("b").alias("print"), F.col("a").alias("node"), "free")
        if not large.take(1):
            break
        entries = mapped(large, _dealt_again, ENTRY)
    every, group, middle = (reduce(DataFrame.unionByName, frames) for frames in (edges, members, middles))
    often = middle.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    most = often.groupBy("a").agg(F.max_by("b", F.struct("n", -F.col("b"))).alias("b"))
    first = most.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    first = staged(first, f"{folder}/middles")
    return staged(every.unionByName(first).distinct(), f"{folder}/edges"), first, staged(group.distinct(), f"{folder}/members")


def _apart(pairs: DataFrame, tied: DataFrame) -> DataFrame:
    """Pairs ``a``, ``b`` whose ends are in different groups so far, with the first members of these, ``root_a`` and ``root_b``."""
    roots_a, roots_b = (tied.select(F.col("a").alias(c), F.col("root").alias(f"root_{c}")) for c in "ab")
    both = pairs.join(roots_a, "a", "left").join(roots_b, "b", "left")
    known = both.select("a", "b", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
    return known.filter("root_a != root_b")


def _merged(tied: DataFrame, links: DataFrame, folder: str) -> DataFrame:
    """``tied`` after more links, which only have to tie whole groups to each other."""
    between = staged(_apart(links, tied).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct(), f"{folder}-between")
    if not between.take(1):
        return tied
    moved = components.roots(between, folder).select(F.col("a").alias("root"), F.col("b").alias("now"))
    members = tied.join(moved, "root", "left").select("a", F.coalesce("now", "root").alias("root"))
    return staged(members.unionByName(moved.select(F.col("root").alias("a"), F.col("now").alias("root"))), f"{folder}-tied")


def near_copies(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``name`` (hash of the text) and ``doc`` of every different text, and ``first``, the text that stands for its group: the one of the smallest id.

    Near copies are texts whose sets of five-word shingles (A-Z in lower case; shorter texts: all their
    words) have a Jaccard similarity of 0.8 or more, among those whose prints are near; groups
    are what near copies connect. Texts without words are equal to none but themselves. Equal texts are one,
    under their smallest id; a missing id (``NO_ID``) is the largest. Other columns are ignored.
    """
    rows = docs.select(*_named(id_col, text_col), F.col(f"`{text_col}`").alias("text"))
    own = mapped(rows, _prints, TEXT).groupBy("name").agg(F.min("doc").alias("doc"), F.first("prints").alias("prints"))
    texts = staged(own.withColumn("node", F.monotonically_increasing_id()), f"{folder}/texts")
    same = staged(texts.groupBy("prints").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("n")), f"{folder}/prints")
    edges, first, members = _candidates(same.select("node", "prints"), folder)
    twins = same.filter("n > 1").select(F.col("node").alias("b"), "prints")
    edges = edges.unionByName(texts.join(twins, "prints").filter("node > b").select(F.col("node").alias("a"), "b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = nodes.join(texts, "node").select("node", "doc", "name")
    bodies = staged(rows.join(wanted, ["doc", "name"]).groupBy("node").agg(F.first("text").alias("text")), f"{folder}/bodies")

    def decided(pairs: DataFrame, name: str) -> DataFrame:
        one = bodies.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
        two = bodies.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        both = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
        return staged(mapped(both, _alike, "a long, b long"), f"{folder}/{name}")

    tied = components.roots(decided(first, "alike-first"), f"{folder}/components-first").withColumnRenamed("b", "root")
    others = _apart(edges, tied).join(first, ["a", "b"], "left_anti").select("a", "b")
    tied = _merged(tied, decided(others, "alike-edges"), f"{folder}/components-edges")
    placed = members.join(tied, "a", "left").select("key", "a", "print", "free", F.coalesce("root", "a").alias("root"))
    mixed_ = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    left = staged(placed.join(mixed_, "key", "left_semi"), f"{folder}/placed")
    right = left.select("key", F.col("a").alias("b"), F.col("print").alias("print_b"), F.col("root").alias("root_b"))
    differ = F.col("print").bitwiseXOR(F.col("print_b"))
    # A pair meets under every mask that leaves out the bits in which it differs; the first of them counts.
    free = [signed(~m & ((1 << BITS) - 1)) for m in covering(list(range(BITS)), RADIUS)]
    first_met = F.coalesce(*[F.when(differ.bitwiseAND(F.lit(~f)) == 0, F.lit(f)) for f in free])
    once = ~F.col("free").isin(free) | (F.col("free") == first_met)
    crosses = (F.col("a") > F.col("b")) & (F.col("root") != F.col("root_b")) & (F.bit_count(differ) <= RADIUS) & once
    crossing = left.join(right, "key").filter(crosses).select("a", "b")
    crossing = crossing.distinct().join(edges, ["a", "b"], "left_anti")
    tied = _merged(tied, decided(crossing, "alike-crossing"), f"{folder}/components")
    grouped = texts.join(tied.withColumnRenamed("a", "node"), "node", "left").select("name", "doc", F.coalesce("root", "node").alias("root"))
    least = F.struct("doc", "name")
    firsts = grouped.groupBy("root").agg(F.min(least).alias("first"))
    return grouped.join(firsts, "root").select("name", "doc", "first")


def _named(id_col: str, text_col: str) -> list:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc")
    return [doc, F.unhex(F.md5(text.cast("binary"))).alias("name")]


def one_of_each(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with all columns, one row of each group of near copies: that of the smallest id.

    Rows without an id come last. Of rows that repeat an id and a text one stays, always the same. Missing
    texts are empty ones. An empty table gives an empty one.
    """
    stays = near_copies(docs, folder, id_col, text_col).filter("first.name = name").select("doc", "name")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), *_named(id_col, text_col))
    order = Window.partitionBy("doc", "name").orderBy(F.xxhash64(F.struct("row")))
    kept = rows.join(stays, ["doc", "name"], "left_semi").withColumn("n", F.row_number().over(order))
    return kept.filter("n = 1").select("row.*")
