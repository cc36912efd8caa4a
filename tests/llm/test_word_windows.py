"""Removed words against a plain reading."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm import cases
from tidemark.llm import word_windows
from tidemark.llm.word_windows import NO_ID, WINDOW, Words, late_windows, pieces, remove_shared_windows


def plain(rows):
    texts = [(NO_ID if r.doc_id is None else r.doc_id, (r.text or "").encode().split()) for r in rows]
    first = {}
    for doc, words in texts:
        for k in range(len(words) - WINDOW + 1):
            window = b" ".join(words[k : k + WINDOW])
            first[window] = min(first.get(window, NO_ID), doc)
    for row, (doc, words) in zip(rows, texts):
        gone = [False] * len(words)
        for k in range(len(words) - WINDOW + 1):
            if first[b" ".join(words[k : k + WINDOW])] < doc:
                gone[k : k + WINDOW] = [True] * WINDOW
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        yield row.doc_id, len(words), sum(gone), sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone)), kept.decode()


def check(docs, folder):
    found = [(r.doc_id, r.n_words, r.n_removed, len(r.spans), r.kept) for r in remove_shared_windows(docs, str(folder)).collect()]
    assert sorted(found, key=str) == sorted(plain(docs.collect()), key=str)
    return found


def shared_passages(spark):
    """Texts that share passages of 49 to 120 words, one template with a number of its own behind it, and copies."""
    draw = random.Random(5)
    passages = [" ".join(draw.choices("abcdefghij", k=draw.choice([49, 50, 51, 70, 120]))) for _ in range(12)]
    own = lambda: " ".join(draw.choices(cases.WORDS, k=draw.randrange(80)))
    texts = [f"{own()}  {draw.choice(passages)}\n{own()} {draw.choice(passages)}\t{own()}" for _ in range(120)]
    texts += [" ".join(cases.WORDS * 4) + f" number {k} {own()}" for k in range(40)]
    texts += [texts[3]] * 4 + ["same " * 500, "same " * 400, "same " * 60]
    draw.shuffle(texts)
    return spark.createDataFrame([(k, t, 1, 2) for k, t in enumerate(texts)], "doc_id long, text string, h long, own long").repartition(5)


def test_awkward_documents(spark, tmp_path):
    assert any(removed for _, _, removed, _, _ in check(cases.documents(spark), tmp_path))


@pytest.mark.parametrize("bucket", [word_windows.BUCKET, 1000])
def test_shared_passages(spark, tmp_path, monkeypatch, bucket):
    # With the small bucket most keys are dealt out again, a window at a time.
    monkeypatch.setattr(word_windows, "BUCKET", bucket)
    check(shared_passages(spark), tmp_path)


def test_given_documents(spark, tmp_path):
    check(cases.known(spark), tmp_path)


def test_no_documents(spark, tmp_path):
    assert check(cases.documents(spark).limit(0), tmp_path) == []


def test_stretches_of_a_text(monkeypatch):
    monkeypatch.setattr(word_windows, "CUT", 300)
    raw = (" ".join(str(k) for k in range(900)) + "  " + "x" * 2000 + " end").encode()
    for overlap in (0, WINDOW - 1):
        seen, words = set(), raw.split()
        for number, part in pieces(raw, overlap):
            own = part.split()
            assert words[number : number + len(own)] == own
            seen |= {(number + k, number + k + overlap + 1) for k in range(len(own) - overlap)}
        assert seen == {(k, k + overlap + 1) for k in range(len(words) - overlap)}


def test_equal_hashes_are_told_apart(monkeypatch):
    packed = [" ".join(f"{w}{k}" for k in range(60)).encode() for w in "aab"]
    docs, keys = np.array([2, 5, 9]), np.zeros(3, np.int64)
    expected = [(1, k, 1) for k in range(11)]
    assert late_windows(packed, keys, docs) == [(1, 0, 11)]
    monkeypatch.setattr(Words, "hashes", lambda self, first, size: np.zeros(len(first), np.uint64))
    assert late_windows(packed, keys, docs) == expected
