"""Late versions against a plain reading of each key's history."""

from __future__ import annotations

import random

from tests.fixtures import day
from tidemark.operators.backdated import scd2_backdated

SCHEMA = "k string, v string, valid_from timestamp_ntz, valid_to timestamp_ntz, is_current boolean"
LATE = "v string, k string, valid_from timestamp_ntz, note int"


def plain(stored, late):
    """The value of every day from 1 to 28, by hand: stored first, then what came late, from its start to the next start."""
    out = {}
    starts = sorted({s[1] for s in stored} | {s[1] for s in late})
    for at in range(1, 29):
        cover = next((s for s in stored if s[1] <= at and (s[2] is None or at < s[2])), None)
        started = [s for s in late if s[1] <= at]
        newest = max(started, key=lambda s: s[1], default=None)
        if newest:
            own = next((s for s in stored if s[1] <= newest[1] and (s[2] is None or newest[1] < s[2])), None)
            end = own[2] if own else None
            following = min((x for x in starts if x > newest[1]), default=None)
            end = min((x for x in (end, following) if x is not None), default=None)
            if (end is None or at < end) and not (cover and cover[1] > newest[1]):
                out[at] = newest[0]
                continue
        if cover:
            out[at] = cover[0]
    return out


def test_random_histories(spark):
    draw = random.Random(4)
    stored, late, expected = [], [], {}
    for k in range(120):
        key = f"k{k}"
        edges = sorted(draw.sample(range(2, 27), draw.choice([0, 2, 4, 6])))
        own = []
        for a, b in zip(edges, edges[1:] + [None]):
            if draw.random() < 0.8:  # else a gap
                own.append((draw.choice("xyz"), a, None if b is None else b))
        coming = [(draw.choice("xyz"), at) for at in draw.sample(range(1, 28), draw.choice([0, 1, 3]))]
        stored += [(key, v, day(a), day(b) if b else None, b is None) for v, a, b in own]
        late += [(v, key, day(a), 1) for v, a in coming]
        expected[key] = plain(own, coming)
    late += late[:5]
    after = scd2_backdated(spark.createDataFrame(stored, SCHEMA), spark.createDataFrame(late, LATE), ["k"], ["v"])
    assert after.columns == ["k", "v", "valid_from", "valid_to", "is_current"]
    found = {key: {} for key in expected}
    for r in after.collect():
        assert r.is_current == (r.valid_to is None) and (r.valid_to is None or r.valid_from < r.valid_to)
        for at in range(1, 29):
            if r.valid_from <= day(at) and (r.valid_to is None or day(at) < r.valid_to):
                assert at not in found[r.k], "versions do not overlap"
                found[r.k][at] = r.v
    assert found == expected


def test_nothing_changes_without_news(spark):
    stored = spark.createDataFrame([("a", "x", day(1), day(5), False), ("a", "y", day(5), None, True), ("b", "x", day(1), None, True)], SCHEMA)
    same = spark.createDataFrame([("x", "a", day(3), 1), ("y", "a", day(9), 1)], LATE)
    for late in (same, same.limit(0)):
        assert sorted(scd2_backdated(stored, late, ["k"], ["v"]).collect()) == sorted(stored.collect())
    new = spark.createDataFrame([("x", "c", day(3), 1)], LATE)
    assert scd2_backdated(stored.limit(0), new, ["k"], ["v"]).collect() == [("c", "x", day(3), None, True)]
