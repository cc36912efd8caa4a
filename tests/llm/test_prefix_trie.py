"""Prefix trees against a plain reading of every prefix."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import prefix_trie as trie

SCHEMA = "conv_id long, turn int, role string, text string, seq string, key string, n long"


def plain(rows):
    """Nodes of the rebuilt conversations of the given rows, of those without ties."""
    own = defaultdict(list)
    for r in rows:
        if r.conv_id is not None:
            own[r.conv_id].append((r.turn is not None, r.turn or 0, r.role or "", r.text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in own.items()}
    members = defaultdict(list)
    ends = defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        source = c - (abs(c) % 5 if c > 0 else -(abs(c) % 5))
        path = own.get(source, [])[:h] + own[c][h:]
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
        ends[tuple(path)].append(c)
    children = defaultdict(int)
    for path in members:
        if path:
            children[path[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for path, convs in members.items():
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in children
            saved[path[:d]] += (len(convs) - 1) * len(path[-1][1].encode()) if path else 0
    for path, convs in members.items():
        digest = hashlib.sha256(",".join(map(str, ends[path])).encode()).hexdigest()
        parent = members[path[:-1]][0] if path else None
        yield convs[0], len(path), parent, len(convs), children[path], leaves[path], saved[path], digest


def check(conversations, folder):
    own = trie.staged(trie.turns(conversations), f"{folder}/own")
    nodes = trie.prefix_trie(trie.rebuilt(own), str(folder))
    assert nodes.columns == trie.RESULT
    found = sorted((tuple(r) for r in nodes.collect()), key=str)
    assert found == sorted(plain(conversations.collect()), key=str)
    return found


def conversations(spark):
    """Shared first turns, copies, long and negative ones, missing values, repeated rows."""
    draw = random.Random(3)
    words = ["", "a", "b", "ünï", "long " * 40]
    rows = []
    for c in [*range(-7, 60), 100, 101, 104, 1000, 1001]:
        for k in range(draw.choice([1, 2, 3, 8, 12])):
            rows.append((c, k, ["user", "assistant"][k % 2], "hello" if k < 2 and c % 3 else draw.choice(words)))
    for c in range(200, 240):  # one conversation over and over, and a long trunk that ends in different turns
        rows += [(c, k, "user", f"turn {k}") for k in range(20)]
        rows += [(c, 20, "user", f"end {c % 7}")] * (c % 2)
    rows += [(300, k, "user", str(k % 3)) for k in range(300)]
    rows += [(7, None, None, None), (8, None, "user", "x"), (8, 0, None, "y"), (9, 0, "user", None)]
    rows += [(None, 1, "user", "a"), (None, None, None, None), rows[0], rows[0]]
    return spark.createDataFrame([(*r, "s", "k", 1) for r in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("shard, packed, joined", [(trie.SHARD, trie.PACKED, trie.JOINED), (200, 400, 3)])
def test_nodes(spark, tmp_path, monkeypatch, shard, packed, joined):
    # The second case deals shards out again many times and cuts the lists of ids.
    for name, value in zip(("SHARD", "PACKED", "JOINED"), (shard, packed, joined)):
        monkeypatch.setattr(trie, name, value)
    check(conversations(spark), tmp_path)


def test_nested_trunks(spark, tmp_path, monkeypatch):
    # Each conversation leaves the common path a turn later, and some end on it.
    monkeypatch.setattr(trie, "SHARD", 100)
    rows = [(5 * c, k, "u", "own" if k == c % 9 else f"t{k}") for c in range(12) for k in range(c % 9 + (c > 3))]
    check(spark.createDataFrame([(*r, "s", "k", 1) for r in rows], SCHEMA), tmp_path)


def test_no_conversations(spark, tmp_path):
    assert check(conversations(spark).limit(0), tmp_path) == []


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 6), max_size=6), min_size=1, max_size=40))
def test_double_array(paths):
    units = [b"".join(bytes([u]) * 16 + (u % 3).to_bytes(8, "big") for u in path) for path in paths]
    strings = trie.Strings(units, [0] * len(units))
    array = trie.pack(strings)
    taken = np.flatnonzero(array.check >= 0)
    prefixes = {tuple(p[:d]) for p in paths for d in range(len(p) + 1)}
    assert len(taken) == len(prefixes) + 1  # the root and its one trunk
    for path, begin, n in zip(paths, strings.begins, strings.lengths):
        state = np.zeros(1, np.int64)
        for k in range(n):
            state = array.step(state, strings.units[begin + k : begin + k + 1])
            assert state[0] > 0
    assert array.step(np.zeros(1, np.int64), np.array([0]))[0] == -1 or len(strings.trunks) == len(strings.sizes)
