"""Suffix sorting and removed bytes against plain readings."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import cases
from tidemark.llm import induced, suffix_dedup

LAST = 1 << 63


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60), st.sampled_from([3, 4_000_000]), st.integers(1, 4))
def test_induced_sorting(symbols, queued, times):
    induced.QUEUED, kept = queued, induced.QUEUED
    try:
        t = symbols * times + [0]
        order, shared = induced.suffix_array(np.array(t), 20)
    finally:
        induced.QUEUED = kept
    expected = sorted(range(len(t)), key=lambda k: t[k:])
    assert order.tolist() == expected
    for a, b, n in zip(expected, expected[1:], shared.tolist()[1:]):
        same = next((k for k in range(len(t)) if t[a : a + k + 1] != t[b : b + k + 1]), 0)
        assert n == min(20, same)


def plain(rows, size=suffix_dedup.WINDOW):
    raw = [(LAST if r.doc_id is None else r.doc_id, (r.text or "").encode()) for r in rows]
    first = {}
    for doc, text in raw:
        for k in range(len(text) - size + 1):
            window = text[k : k + size]
            first[window] = min(first.get(window, (LAST + 1, 0)), (doc, k))
    for row, (doc, text) in zip(rows, raw):
        gone = bytearray(len(text))
        for k in range(len(text) - size + 1):
            if first[text[k : k + size]] < (doc, k):
                gone[k : k + size] = b"\1" * size
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        yield row.doc_id, len(text), runs, bytes(c for c, g in zip(text, gone) if not g)


def found(frame):
    return sorted(((r.doc_id, r.n_bytes, len(r.spans), bytes(r.kept)) for r in frame.collect()), key=str)


@pytest.mark.parametrize("shares", [(16, 10_000, 16 << 20), (1, 3_000_000, 16 << 20), (16, 10_000, 0)])
def test_awkward_documents(spark, tmp_path, monkeypatch, shares):
    monkeypatch.setattr(suffix_dedup, "LARGE", shares[2])
    # The second case takes every anchor that occurs often for hot, the third every key for too large to be sorted.
    for name, value in zip(("SAMPLE", "HOT"), shares):
        monkeypatch.setattr(suffix_dedup, name, value)
    docs = cases.documents(spark)
    assert found(suffix_dedup.remove_repeats(docs, str(tmp_path))) == sorted(plain(docs.collect()), key=str)
    assert suffix_dedup.remove_repeats(docs.limit(0), str(tmp_path / "none")).collect() == []


@pytest.mark.parametrize("hot", [False, True])
def test_shared_passages(spark, tmp_path, monkeypatch, hot):
    draw = random.Random(7)
    word = lambda: "".join(draw.choice("abcdé") for _ in range(draw.randint(1, 7)))
    passages = [" ".join(word() for _ in range(draw.randint(15, 60))) for _ in range(12)]
    texts = []
    for k in range(260):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40))), draw.choice(passages), word(), draw.choice(passages)]
        text = list(" ".join(parts))
        for _ in range(draw.randint(0, 4)):
            text[draw.randrange(len(text))] = draw.choice("xyz")
        texts.append("".join(text) if k % 9 else texts[draw.randrange(len(texts))] if texts else "")
    texts += ["ab" * 400, "ab" * 300 + "c", "a" * 350, "a" * 349 + "b"]
    rows = [(k - 3, t) for k, t in enumerate(texts)]
    draw.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    monkeypatch.setattr(suffix_dedup, "HASHED", 5000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7" if hot else "50")  # keys go on in the next batch
    monkeypatch.setattr(suffix_dedup, "SORTED", 20_000)
    if hot:
        monkeypatch.setattr(suffix_dedup, "hot_anchors", lambda docs: every_anchor(texts))
    try:
        assert found(suffix_dedup.remove_repeats(docs, str(tmp_path))) == sorted(plain(docs.collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def every_anchor(texts):
    """Half of the anchors there are."""
    out = [np.zeros(0, np.uint64)]
    for t in texts:
        raw = np.frombuffer(t.encode(), np.uint8)
        out.append(suffix_dedup.segments(raw, len(raw) - np.arange(len(raw)))[0])
    return np.unique(np.concatenate(out))[::2]


def test_given_documents(spark, tmp_path):
    docs = cases.queries.documents(spark, cases.SMALL)
    assert found(suffix_dedup.remove_repeats(docs, str(tmp_path))) == sorted(plain(docs.collect()), key=str)
