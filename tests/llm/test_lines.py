"""Line dedup against a plain pass over all lines."""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm import cases
from tidemark.llm import line_dedup
from tidemark.llm.perfect_hash import PerfectHash

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if c.isascii() else c for c in line.strip(BLANKS))


def plain(rows):
    last = 1 << 63
    holders = defaultdict(set)
    for r in rows:
        for line in (r.text or "").split("\n"):
            if len(key(line)) >= 10:
                holders[key(line)].add(last if r.doc_id is None else r.doc_id)
    for r in rows:
        lines = (r.text or "").split("\n")
        own = last if r.doc_id is None else r.doc_id
        gone = [len(holders[key(x)]) > 1 and min(holders[key(x)]) != own if key(x) in holders else False for x in lines]
        yield r.doc_id, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)


@pytest.mark.parametrize("shard", [200_000, 7])
def test_lines(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", shard)
    docs = cases.known(spark) if shard > 7 else cases.documents(spark)
    found = line_dedup.dedup_lines(docs, str(tmp_path))
    assert Counter(map(tuple, found.collect())) == Counter(plain(docs.collect()))


def test_other_columns_stay(spark, tmp_path):
    docs = cases.documents(spark)
    found = line_dedup.without_shared_lines(docs, str(tmp_path))
    assert found.schema == docs.schema
    texts = {r.text for r in found.collect()}
    assert None in texts and "\nown line of five\n" not in texts
    empty = docs.limit(0)
    assert line_dedup.without_shared_lines(empty, str(tmp_path / "0")).collect() == []


def test_perfect_hash_is_minimal():
    draw = np.random.default_rng(1)
    high, low = draw.integers(0, 1 << 63, (2, 50_000)).astype(np.uint64)
    high[:10] = high[0]  # equal halves of different keys
    numbers = PerfectHash.of(high, low).numbers(high, low)
    assert sorted(numbers) == list(range(len(high)))
    none = np.zeros(0, np.uint64)
    assert PerfectHash.of(none, none).numbers(high[:3], low[:3]).tolist() == [-1] * 3
    with pytest.raises(ValueError, match="repeat"):
        PerfectHash.of(np.zeros(2, np.uint64), np.zeros(2, np.uint64))
