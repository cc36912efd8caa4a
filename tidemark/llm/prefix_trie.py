"""Prefix tree of conversations, from double arrays packed per prefix shard.

1. Every turn becomes a unit of fixed size (hash of role and text, bytes of the text), a conversation
   the string of its units. Equal strings count once, with how many conversations have them.
2. A shard is all strings with one first unit. A shard of more than ``SHARD`` bytes is dealt out again
   behind the prefix its strings have in common, its trunk, for as long as that leaves one too large.
3. Whole shards, some megabytes at a time, become one double array over units numbered densely:
   the child of state s by unit u is BASE[s] + u if CHECK there is s. Walking the strings through it
   gives the nodes and their sums below the trunk, and one sum for what hangs under each trunk.
4. The sums under equal trunks are added up, and one more double array over the few trunks gives the
   upper nodes, which the shards share.

The ids that end at a node are hashed as one sorted stream, never held together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import batches, mapped, staged, whole_keys

#: Bytes of a unit: 16 of the turn's hash, 8 for the bytes of its text.
UNIT = 24
#: A shard is dealt out again beyond so many bytes of strings; whole shards of so many bytes share a double array.
SHARD, PACKED = 32 << 20, 4 << 20
#: Ids joined to one piece of text before they go to their node.
JOINED = 8192
#: Free places tried for the children of a state before they go behind all others.
TRIED = 32
NO_ENDS = hashlib.sha256(b"").hexdigest()
RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
NODES = ", ".join(f"{c} long" for c in RESULT[:-1]) + ", ends_sha256 string, trunk binary, summary boolean"


class DoubleArray:
    """States 0 (the root) and up; free places have CHECK -1."""

    def __init__(self) -> None:
        self.base, self.check = np.zeros(1024, np.int64), np.full(1024, -1, np.int64)
        self.check[0] = 0
        self.low = self.top = 1  # all places below the first are taken, all from the second on are free

    def _reach(self, size: int) -> None:
        if size > len(self.check):
            more = max(size, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, np.int64)])

    def _free(self, n: int) -> np.ndarray:
        """The first ``n`` free places."""
        size = 2 * n + 64
        while True:
            self._reach(self.low + size)
            found = np.flatnonzero(self.check[self.low : self.low + size] < 0)
            if len(found) >= n:
                return found[:n] + self.low
            size *= 2

    def _put(self, state: int, units: np.ndarray) -> None:
        for place in self._free(TRIED).tolist():
            slots = place - units[0] + units
            self._reach(int(slots[-1]) + 1)
            if (self.check[slots] < 0).all():
                break
        else:
            slots = self.top - units[0] + units
            self._reach(int(slots[-1]) + 1)
        self.base[state] = slots[0] - units[0]
        self.check[slots] = state
        self.top = max(self.top, int(slots[-1]) + 1)

    def add(self, states: np.ndarray, units: np.ndarray) -> None:
        """Children for childless states: (state, unit) pairs, each once and sorted."""
        heads = np.flatnonzero(np.concatenate([[True], states[1:] != states[:-1]]))
        counts = np.diff(np.append(heads, len(states)))
        for k in np.flatnonzero(counts > 1):
            self._put(int(states[heads[k]]), units[heads[k] : heads[k] + counts[k]])
        alone = heads[counts == 1]
        if len(alone):
            places = self._free(len(alone))
            self.base[states[alone]], self.check[places] = places - units[alone], states[alone]
            self.low = int(places[-1]) + 1
            self.top = max(self.top, self.low)

    def step(self, states: np.ndarray, units: np.ndarray) -> np.ndarray:
        """The states' children by these units, -1 where there is none."""
        places = self.base[states] + units
        inside = (places > 0) & (places < len(self.check))
        places = np.where(inside, places, 0)
        return np.where(inside & (self.check[places] == states), places, -1)


def _units(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"S{UNIT}") if raw else np.zeros(0, f"S{UNIT}")


class Strings:
    """Strings of units with dense numbers; the first unit of each is its trunk's."""

    def __init__(self, strings: list[bytes], trunks: list[int]) -> None:
        heads = [s[: t * UNIT] for s, t in zip(strings, trunks)]
        tails = [s[t * UNIT :] for s, t in zip(strings, trunks)]
        self.trunks = sorted(set(heads))
        number = {h: k for k, h in enumerate(self.trunks)}
        own, units = np.unique(_units(b"".join(tails)), return_inverse=True)
        raw = np.frombuffer(own.astype(f"S{UNIT}").tobytes(), np.uint8).reshape(-1, UNIT)
        #: Bytes of the text of each unit, none for trunks.
        self.sizes = np.concatenate([raw[:, 16:].copy().view(">i8").astype(np.int64).ravel(), np.zeros(len(self.trunks), np.int64)])
        lengths = np.array([len(x) // UNIT for x in tails], np.int64)
        self.lengths = lengths + 1
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.units = np.empty(int(self.lengths.sum()), np.int64)
        head = np.zeros(len(self.units), bool)
        head[self.begins] = True
        self.units[head] = len(own) + np.array([number[h] for h in heads], np.int64)
        self.units[~head] = units
        self.depths = np.array([len(h) // UNIT for h in heads], np.int64)


def pack(strings: Strings) -> DoubleArray:
    """The double array of all strings, level by level."""
    array, wide = DoubleArray(), len(strings.sizes)
    states = np.zeros(len(strings.lengths), np.int64)
    live, depth = np.arange(len(states)), 0
    while len(live):
        units = strings.units[strings.begins[live] + depth]
        pairs = np.unique(states[live] * wide + units)
        array.add(pairs // wide, pairs % wide)
        states[live] = array.step(states[live], units)
        depth += 1
        live = live[strings.lengths[live] > depth]
    return array


def nodes(strings: Strings, array: DoubleArray, table: pa.Table) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Sums of every state but the root, in order of depth below the trunk, and the last state of each string.

    ``table``: ``n`` and ``first`` of each string, and what hangs below its last state without being
    here: ``leaves``, ``saved``, ``children``.
    """
    given = {c: table.column(c).to_numpy() for c in ("n", "first", "leaves", "saved", "children")}
    size = len(array.check)
    count, first, depth = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    unit = np.zeros(size, np.int64)
    children, leaves, saved = (np.zeros(size, np.int64) for _ in range(3))
    states = np.zeros(len(strings.lengths), np.int64)
    live, level, levels = np.arange(len(states)), 0, []
    while len(live):
        units = strings.units[strings.begins[live] + level]
        now = states[live] = array.step(states[live], units)
        np.add.at(count, now, given["n"][live])
        np.minimum.at(first, now, given["first"][live])
        unit[now], depth[now] = units, strings.depths[live] + level
        levels.append(np.unique(now))
        np.add.at(children, array.check[levels[-1]], 1)
        level += 1
        live = live[strings.lengths[live] > level]
    for total, c in ((children, "children"), (leaves, "leaves"), (saved, "saved")):
        np.add.at(total, states, given[c])
    for some in reversed(levels):
        leaves[some] += children[some] == 0
        saved[some] += (count[some] - 1) * strings.sizes[unit[some]]
        np.add.at(leaves, array.check[some], leaves[some])
        np.add.at(saved, array.check[some], saved[some])
    order = np.concatenate(levels) if levels else states
    found = {"state": order, "parent": array.check[order], "unit": unit[order], "depth": depth[order]}
    found |= {"n": count[order], "first": first[order], "children": children[order], "leaves": leaves[order], "saved": saved[order]}
    return found | {"parent_first": first[found["parent"]]}, states


def _tree(table: pa.Table, upper: bool, schema: pa.Schema) -> pa.RecordBatch:
    """Node rows of some strings; for trunks a summary each, or if they are the upper nodes, nodes like others."""
    strings = Strings(table.column("seq").to_pylist(), table.column("t").to_pylist())
    array = pack(strings)
    found, last = nodes(strings, array, table)
    is_trunk = found["unit"] >= len(strings.sizes) - len(strings.trunks)
    ends = np.full(len(array.check), NO_ENDS, object)
    ends[last] = [e or NO_ENDS for e in table.column("ends").to_pylist()]
    named = np.full(len(array.check), None, object)  # states that rows below a trunk look up
    if upper:
        named[last] = table.column("seq").to_pylist()
    trunk_of = [strings.trunks[u] if 0 <= u < len(strings.trunks) else None for u in found["unit"] - (len(strings.sizes) - len(strings.trunks))]
    named[found["state"][is_trunk]] = [x for x in trunk_of if x is not None]
    below = np.isin(found["parent"], found["state"][is_trunk])
    if upper:
        trunks, is_top, parent_known = named[found["state"]], np.zeros(len(is_trunk), bool), ~is_trunk
    else:
        is_top, parent_known = is_trunk, ~is_trunk & ~below
        trunks = np.where(is_trunk, named[found["state"]], np.where(below, named[found["parent"]], None))
    columns = [
        pa.array(found["first"]), pa.array(found["depth"]), pa.array(found["parent_first"], mask=~parent_known), pa.array(found["n"]),
        pa.array(found["children"]), pa.array(found["leaves"]), pa.array(found["saved"]), pa.array(ends[found["state"]].tolist(), pa.string()),
        pa.array(trunks.tolist(), pa.binary()), pa.array(is_top),
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _shards(source: Iterator[pa.RecordBatch], schema: pa.Schema, size: int) -> Iterator[pa.RecordBatch]:
    for table in whole_keys(source, size):
        yield _tree(table, False, schema)


def _upper(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held = [b for b in source if b.num_rows]
    if held:
        yield _tree(pa.Table.from_batches(held), True, schema)


def _join_ids(source: Iterator[pa.RecordBatch], schema: pa.Schema, most: int) -> Iterator[pa.RecordBatch]:
    """Sorted (key, conv_id) rows as (key, first id, ids joined by commas)."""

    def rows() -> Iterator[tuple]:
        held: list[int] = []
        last = None
        for b in source:
            for key, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if held and (key != last or len(held) >= most):
                    yield last, held[0], ",".join(map(str, held))
                    held = []
                last = key
                held.append(conv)
        if held:
            yield last, held[0], ",".join(map(str, held))

    yield from batches(rows(), schema)


def _hash_ids(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Hash of the joined ids of each key, whose pieces come in order."""

    def rows() -> Iterator[tuple]:
        last, digest = None, None
        for b in source:
            for key, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if key != last:
                    if digest:
                        yield last, digest.hexdigest()
                    last, digest = key, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
        if digest:
            yield last, digest.hexdigest()

    yield from batches(rows(), schema)


def _common(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """How many units the smallest and the largest string of a shard share, and so all of it."""
    for b in source:
        shared = []
        for lo, hi in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
            n = min(len(lo), len(hi)) // UNIT
            x, y = (_units(s[: n * UNIT]) for s in (lo, hi))
            differs = np.flatnonzero(x != y)
            shared.append(int(differs[0]) if len(differs) else n)
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(shared, pa.int32())], schema=schema)


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv_id`` and ``seq``, the units of its turns in order: turns without a number first, equal ones by role and the text's hash."""
    role, text = (F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in (role_col, text_col))
    name = F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256), 1, 32)
    unit = F.concat(name, F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))
    turn = F.col(f"`{turn_col}`")
    place = F.struct(turn.isNotNull().alias("known"), turn.alias("turn"), role.alias("role"), unit.alias("unit"))
    rows = conversations.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), place.alias("place")).filter("conv_id is not null")
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("place")).alias("places"))
    return ordered.select("conv_id", F.unhex(F.array_join("places.unit", "")).alias("seq"))


def rebuilt(own: DataFrame, family: int = 5, heads: int = 9) -> DataFrame:
    """Conversations that go on behind the head of another: the first h turns of conversation c - c % ``family``
    (none if it is absent), then the own ones after the first h, where h is crc32(c) % ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int") * UNIT
    source = own.filter(F.col("conv_id") % family == 0)
    source = source.select(F.col("conv_id").alias("source"), F.substring("seq", 1, (heads - 1) * UNIT).alias("head"))
    joined = own.join(source, F.col("conv_id") - F.col("conv_id") % family == F.col("source"), "left")
    empty = F.lit(b"")
    head = F.coalesce(F.substring(F.col("head"), F.lit(1), h), empty)
    return joined.select("conv_id", F.concat(head, F.substring(F.col("seq"), h + 1, F.length("seq"))).alias("seq"))


def _prefix(units: Column) -> Column:
    return F.substring(F.col("seq"), F.lit(1), (units * UNIT).cast("int"))


def _dealt(strings: DataFrame, folder: str) -> DataFrame:
    """``strings`` with ``t``, the units of the trunk of their shard."""
    dealt, behind = strings.withColumn("t", F.lit(0)), F.length("seq") > F.col("t") * UNIT
    for k in range(1 << 16):
        own = dealt.filter(behind).withColumn("prefix", _prefix(F.col("t") + 1))
        sizes = own.groupBy("prefix").agg(F.sum(F.length("seq")).alias("size"), F.count(F.lit(1)).alias("strings"))
        large = staged(sizes.filter((F.col("size") > SHARD) & (F.col("strings") > 1)).select("prefix"), f"{folder}/large-{k}")
        if not large.take(1):
            return dealt
        ends = own.join(large, "prefix", "left_semi").groupBy("prefix").agg(F.min("seq").alias("lo"), F.max("seq").alias("hi"))
        deeper = staged(mapped(ends, _common, "prefix binary, deeper int"), f"{folder}/deeper-{k}")
        named = dealt.withColumn("prefix", F.when(behind, _prefix(F.col("t") + 1)))
        columns = [*strings.columns, F.coalesce("deeper", "t").alias("t")]
        dealt = staged(named.join(deeper, "prefix", "left").select(*columns), f"{folder}/dealt-{k}")
    raise RuntimeError("shards do not get smaller")


def prefix_trie(sequences: DataFrame, folder: str) -> DataFrame:
    """One row per node of the prefix tree of ``sequences`` (``conv_id``, each once; ``seq`` as of ``turns``).

    A node is a sequence of first turns, the root the empty one. conv_id is its smallest member,
    parent_conv_id that of its parent (root: null); n_convs, n_children; n_leaves, the childless nodes of
    its subtree; saved_tokens, summed over its subtree, (n_convs - 1) times the bytes of the last text;
    ends_sha256, SHA-256 of the ids of the members that end there, ascending and joined by commas. An empty table has no nodes, not even a root.
    One conversation's units (24 bytes a turn) must fit a task.
    """
    rows = staged(sequences.select("conv_id", "seq", F.sha2("seq", 256).alias("key")), f"{folder}/sequences")
    ids = rows.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = mapped(ids, partial(_join_ids, most=JOINED), "key string, conv_id long, ids string")
    ends = mapped(joined.repartition("key").sortWithinPartitions("key", "conv_id"), _hash_ids, "key string, ends string")
    strings = rows.groupBy("key", "seq").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first"))
    zeros = [F.lit(0).cast("long").alias(c) for c in ("leaves", "saved", "children")]
    strings = staged(strings.join(ends, "key").select("seq", "n", "first", "ends", *zeros), f"{folder}/strings")
    dealt = _dealt(strings, folder)
    behind = F.length("seq") > F.col("t") * UNIT
    shards = dealt.filter(behind).select(F.xxhash64(_prefix(F.col("t") + 1)).alias("shard"), *dealt.columns)
    lower = staged(mapped(shards.repartition("shard").sortWithinPartitions("shard"), partial(_shards, size=PACKED), NODES), f"{folder}/lower")
    sums = lower.filter("summary").select(
        F.col("trunk").alias("seq"), F.col("n_convs").alias("n"), F.col("conv_id").alias("first"), F.lit(None).cast("string").alias("ends"),
        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), F.col("n_children").alias("children"),
    )
    trunks = sums.unionByName(dealt.filter(~behind).drop("t")).groupBy("seq").agg(
        F.max("ends").alias("ends"), F.min("first").alias("first"), *(F.sum(c).alias(c) for c in ("n", "leaves", "saved", "children"))
    )
    upper = staged(mapped(trunks.withColumn("t", F.lit(0)).repartition(1), _upper, NODES), f"{folder}/upper")
    below = lower.filter("not summary")
    parents = upper.filter("trunk is not null").select("trunk", F.col("conv_id").alias("found"))
    tops = below.filter("trunk is not null").join(parents, "trunk").withColumn("parent_conv_id", F.col("found"))
    inner = below.filter("trunk is null")
    return inner.select(*RESULT).unionByName(tops.select(*RESULT)).unionByName(upper.select(*RESULT))
