"""Fingerprints and classes against brute force."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
import xxhash

from tests.llm import cases
from tidemark.llm import components, simhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(prints):
    """Root of every distinct fingerprint."""
    prints = sorted(set(prints))
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for k, a in enumerate(prints):
        for b in prints[k + 1 :]:
            if (a ^ b).bit_count() <= 2:
                parent[root(b)] = root(a)
    return {p: root(p) for p in prints}


def test_every_two_bits_are_free_in_some_mask():
    for a in range(64):
        for b in range(64):
            tables = [t for t, m in enumerate(simhash.FIRST) if not m >> a & 1 and not m >> b & 1]
            assert tables
            for t in tables:
                assert any(not m >> a & 1 and not m >> b & 1 for m in simhash.SECOND[t])
    assert max(64 - m.bit_count() - n.bit_count() for m, inner in zip(simhash.FIRST, simhash.SECOND) for n in inner) <= 12


def test_classes(spark, tmp_path):
    docs = cases.known(spark)
    rows = docs.collect()
    prints = [plain(r.text) if len(r.text or "") < 40_000 else simhash.fingerprint(r.text) % (1 << 64) for r in rows]
    roots = classes(prints)
    least = {}
    for r, p in zip(rows, prints):
        if r.doc_id is not None:
            least[roots[p]] = min(least.get(roots[p], r.doc_id), r.doc_id)
    expected = Counter((r.doc_id, p, least.get(roots[p])) for r, p in zip(rows, prints))
    found = simhash.near_duplicates(docs, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == expected


def test_one_row_of_each_class_stays(spark, tmp_path):
    docs = cases.known(spark)
    found = simhash.near_duplicates(docs, str(tmp_path / "a"))
    kept = simhash.one_of_each(docs, str(tmp_path / "b"))
    assert kept.schema == docs.schema
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == {r.component_id for r in found.collect()}
    assert len(ids) == len(set(classes([r.fp % (1 << 64) for r in found.collect()]).values()))
    awkward = cases.documents(spark)
    assert simhash.one_of_each(awkward, str(tmp_path / "c")).schema == awkward.schema
    nameless = awkward.filter("doc_id is null")
    assert simhash.one_of_each(nameless, str(tmp_path / "d")).count() == 2
    assert simhash.one_of_each(awkward.limit(0), str(tmp_path / "e")).collect() == []


@pytest.mark.parametrize("bucket", [2048, 3])
def test_links_lose_none(spark, tmp_path, monkeypatch, bucket):
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    draw = random.Random(bucket)
    prints = {draw.getrandbits(64) for _ in range(40)} | {0, (1 << 64) - 1}
    for p in list(prints):
        for _ in range(draw.randint(0, 30)):
            q = p
            for _ in range(draw.randint(1, 4)):
                q ^= 1 << draw.randrange(64)
            prints.add(q)
    frame = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long").repartition(3)
    tied = components.roots(simhash.links(frame, str(tmp_path)), str(tmp_path / "c"))
    found = {r.a % (1 << 64): r.b % (1 << 64) for r in tied.collect()}
    groups = Counter(classes(prints).values())
    mine = Counter(found.get(p, p) for p in prints)
    assert sorted(groups.values()) == sorted(mine.values())


def test_components_of_a_long_path(spark, tmp_path):
    edges = [(k, k + 1) for k in range(300)] + [(500, 500), (601, 600)]
    found = components.roots(spark.createDataFrame(edges, "a long, b long"), str(tmp_path))
    assert {(r.a, r.b) for r in found.collect()} == {(k, 0) for k in range(1, 301)} | {(601, 600)}
