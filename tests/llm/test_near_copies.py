"""Groups of near copies against the similarity of all pairs."""

from __future__ import annotations

import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tidemark.llm import near_copies
from tidemark.llm.near_copies import NO_ID, alike, covering, near_groups, prints_of, shingles


def pairs_alike(texts):
    """Pairs of the texts with a Jaccard similarity of 0.8 or more, by all shingles they have in common."""
    sets = [shingles(t) for t in texts]
    holders = defaultdict(list)
    for k, own in enumerate(sets):
        for s in own or [None]:
            holders[s].append(k)
    shared = defaultdict(int)
    for some in holders.values():
        for a, b in combinations(some, 2):
            shared[a, b] += 1
    return [(a, b) for (a, b), n in shared.items() if 5 * n >= 4 * (len(sets[a]) + len(sets[b]) - n) or not sets[a]]


def have_near_prints(texts):
    prints = [prints_of(t) for t in texts]
    return lambda a, b: np.bitwise_count(prints[a] ^ prints[b]).min() <= near_copies.RADIUS


def groups(texts, linked=lambda a, b: True):
    """Number of the first text of the group of each text, by the alike pairs that ``linked`` holds for."""
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs_alike(texts):
        if not linked(a, b):
            continue
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(k) for k in range(len(texts))]


def first_of_each(docs):
    """The first document of each group, by id."""
    docs = sorted(docs, key=lambda d: (d.doc_id is None, d.doc_id or 0))
    roots = groups([d.text for d in docs])
    return [d for k, d in enumerate(docs) if roots[k] == k]


def edited(draw, words, share):
    """Words with a share of them replaced, left out or put in."""
    out = list(words)
    for _ in range(int(len(words) * share)):
        k = draw.randrange(len(out))
        out[k : k + draw.choice([0, 1, 2])] = draw.choice([[], [f"new{draw.randrange(999)}"]])
    return out


def families(spark):
    draw = random.Random(9)
    vocabulary, weights = [f"w{k}" for k in range(3000)], [1 / (k + 2) for k in range(3000)]
    rows = []
    for _ in range(60):
        words = draw.choices(vocabulary, weights, k=draw.choice([60, 150, 400]))
        rows += [" ".join(edited(draw, words, draw.choice([0, 0.01, 0.02, 0.03, 0.1, 0.3]))) for _ in range(draw.choice([1, 2, 6]))]
    chain = draw.choices(vocabulary, weights, k=300)  # each like the next one, the ends unlike each other
    for k in range(30):
        chain = [*chain[12:], *draw.choices(vocabulary, weights, k=12)] if k % 2 else edited(draw, chain, 0.01)
        rows.append(" ".join(chain))
    large = draw.choices(vocabulary, weights, k=300)
    rows += [" ".join(edited(draw, large, 0.01)) for _ in range(80)]
    rows += [rows[3], rows[3].upper(), rows[5].replace(" ", "\n")]
    draw.shuffle(rows)
    return spark.createDataFrame([(2 * k, t, 1, "x") for k, t in enumerate(rows)], "doc_id long, text string, n int, name string").repartition(4)


@pytest.mark.parametrize("bucket", [near_copies.BUCKET, 32])
def test_families(spark, tmp_path, monkeypatch, bucket):
    # With the small bucket many are dealt out again.
    monkeypatch.setattr(near_copies, "BUCKET", bucket)
    docs = families(spark)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    texts = [r.text for r in rows]
    roots = dict(zip((r.doc_id for r in rows), groups(texts, have_near_prints(texts))))
    found = near_copies.near_copies(docs, str(tmp_path)).collect()
    assert len(found) == len({r.text for r in rows})
    assert {r.doc: r["first"].doc for r in found} == {r.doc: rows[roots[r.doc]].doc_id for r in found}
    kept = near_copies.one_of_each(docs, str(tmp_path / "again"))
    assert kept.schema == docs.schema
    kept, expected = {r.doc_id for r in kept.collect()}, {d.doc_id for d in first_of_each(rows)}
    assert kept == {rows[k].doc_id for k in roots.values()}
    assert expected <= kept and len(rows) - len(kept) >= 0.9 * (len(rows) - len(expected))


def test_given_documents(spark, tmp_path):
    """At least nine in ten of the documents that have an earlier near copy go, and no other does."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.collect()
    expected = {d.doc_id for d in first_of_each(rows)}
    kept = {r.doc_id for r in near_copies.one_of_each(docs, str(tmp_path)).collect()}
    assert expected <= kept
    assert len(rows) - len(kept) >= 0.9 * (len(rows) - len(expected))


def test_awkward_documents(spark, tmp_path):
    docs = cases.documents(spark)
    kept = near_copies.one_of_each(docs, str(tmp_path)).collect()
    expected = first_of_each(docs.collect())
    assert sorted((r.doc_id or NO_ID, r.text or "") for r in kept) == sorted((d.doc_id or NO_ID, d.text or "") for d in expected)
    assert near_copies.one_of_each(docs.limit(0), str(tmp_path / "none")).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 63), min_size=1, max_size=3))
def test_masks_cover_every_difference(differ):
    for bits in (list(range(64)), sorted(differ | set(range(0, 64, 5)))):
        assert any(not any(mask >> b & 1 for b in differ) for mask in covering(bits, 3))


def test_groups_hold_what_is_near():
    draw = np.random.default_rng(3)
    seeds = draw.integers(0, 1 << 63, 40, dtype=np.uint64)
    prints = np.concatenate([seeds, *(seeds ^ np.uint64(1 << k) for k in range(5)), draw.integers(0, 1 << 63, 9, dtype=np.uint64)])
    found = list(near_groups(prints))
    assert sorted(len(group) for group, _, _ in found) == [6] * 40 and {m for _, _, m in found} == set(range(40))
    for group, by, _ in found:
        assert by[0] == group[0] and all((int(prints[a]) ^ int(prints[b])).bit_count() <= 3 for a, b in zip(group, by))


def test_alike():
    words = [str(k) for k in range(104)]
    assert alike(" ".join(words), "  ".join(words).upper()) and alike(None, " \n")
    assert alike(" ".join(words), " ".join(words[:-20])) and not alike(" ".join(words), " ".join(words[:-21]))
    assert alike("a b", "A\nb") and not alike("a b", "a c") and not alike("a", None)
