"""Counts and verdicts against a plain reading of the rules."""

from __future__ import annotations

import base64
import re
from collections import Counter

import numpy as np
from hypothesis import given
from hypothesis import strategies as st

from tests.llm import cases
from tidemark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    counts = (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)))
    return (*counts, len(covered), failed)


def test_measure(spark):
    docs = cases.known(spark)
    found = quality.measure(docs).collect()
    texts = docs.collect()
    key = lambda r: (r[0] is None, r[0] or 0)
    assert Counter(tuple(r[:7]) for r in found) == Counter((r.doc_id, *plain(r.text)) for r in texts)
    assert all(not r.kept for r in found if r.base_failed)
    assert sorted(map(key, found)) == sorted(map(key, texts))


def test_repetition_and_noise_go_and_good_rows_stay(spark):
    rules = quality.Rules()
    good = cases.queries.documents(spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/labels.parquet").filter("quality = 1"), "doc_id"
    )
    found = quality.measure(good).filter("not base_failed").agg({"*": "count"}).first()[0]
    assert quality.measure(good).filter("kept").count() >= 0.99 * found
    draw = np.random.default_rng(3)
    regular = rules.measure(" ".join(f"item{k:06d}" for k in range(3000)))
    assert (regular[5], regular[-1]) == (False, False)
    noise = base64.b85encode(draw.bytes(8000)).decode()
    scrambled = rules.measure(" ".join(noise[k : k + 40] for k in range(0, len(noise), 40)))
    assert (scrambled[5], scrambled[-1]) == (False, False)


def noise(kind, n):
    draw = np.random.default_rng(n)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    if kind == "words":
        return " ".join("".join(letters[c] for c in draw.integers(0, 26, k)) for k in draw.integers(2, 10, n // 6))[:n]
    dense = {
        "base64": base64.b64encode(draw.bytes(n)).decode(), "hex": draw.bytes(n).hex(), "letters": "".join(letters[c] for c in draw.integers(0, 62, n))
    }[kind.partition("-")[0]]
    run = int(kind.partition("-")[2])
    return " ".join(dense[k : k + run] for k in range(0, n, run))[:n]


def test_noise_goes_at_every_length():
    rules = quality.Rules()
    for n in (1024, 1500, 2100, 3100, 4100, 9000, 20_000, 70_000, 140_000):
        for kind in ("base64-10", "letters-10", "words", "base64-76", "hex-8", "hex-32"):
            if (n >= 2100 or "hex" not in kind) and (n >= 4100 or "76" not in kind):
                found = rules.measure(noise(kind, n))
                assert (found[5], found[-1]) == (False, False), (kind, n, found)
    for n in (700, 900):
        assert not rules.measure(noise("base64-10", n))[-1] and not rules.measure(noise("letters-10", n))[-1]


def test_half_noise_goes_wherever_it_stands(spark):
    rules = quality.Rules()
    rows = cases.queries.documents(spark, "/root/testdata/sf0.01").filter("n_chars > 9200").orderBy("doc_id").collect()
    good = [r.text[:9000] for r in rows if rules.measure(r.text)[-1] and rules.measure(r.text[:9000])[-1]][:5]
    assert good
    for text in good:
        for kind in ("base64-10", "base64-76", "letters-10", "words"):
            for size in (3000, 4600, 9000):
                half = noise(kind, size * 8 // 9)
                for mixed in (f"{text[:size]} {half}", f"{half} {text[:size]}"):
                    found = rules.measure(mixed)
                    assert (found[5], found[-1]) == (False, False), (kind, size, found)


def test_filter_keeps_columns_and_an_empty_table(spark):
    docs = cases.documents(spark)
    assert quality.keep_good(docs).schema == docs.schema
    kept = {r.doc_id for r in quality.measure(cases.known(spark)).filter("kept").collect()}
    assert {r.doc_id for r in quality.keep_good(cases.known(spark)).collect()} == kept
    assert quality.measure(docs.limit(0)).collect() == [] and quality.keep_good(docs.limit(0)).collect() == []


@given(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40))
def test_repeated_words(words):
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    assert quality.repeated_words(words) == len(covered)
