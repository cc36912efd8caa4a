"""Bytes covered by a long string that also starts earlier, found by suffix sorting in shards.

Which strings must meet is settled by their content. Of the ``GRAM``-byte strings inside a window
of ``WINDOW`` bytes the one with the smallest hash is the window's anchor, so equal windows have
equal anchors. Neighbouring windows with one anchor form a segment.

1. Every task hashes the segments of its documents and keeps the first of equal ones; the others
   are covered and only pass by. One row per segment goes to its anchor's partition.
2. There, of equal segments again only the first one stays open, and only where an anchor has
   several different ones. Anchors that hold more than their share of a sample are dealt out finer,
   by all the bytes that eight neighbouring windows have in common.
3. The open segments fetch their bytes and go to shards by anchor. A shard is sorted, some
   megabytes of whole anchors at a time, by induced sorting with queues that spill to disk; in
   the sorted order, windows that share ``WINDOW`` bytes stand next to each other, and all but the
   first one in the corpus are covered.
   The windows of an anchor that holds more than a shard's worth of different segments meet by their 128-bit
   hash instead, first by partial minima: however many texts follow a template, no task holds them.
4. Covered windows go back to their documents.

Only segments of strings that occur twice ever travel as bytes, and a group of copies costs one
row per task and segment, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import arrow_schema, batches, staged, type_of
from tidemark.llm.induced import suffix_array
from tidemark.llm.perfect_hash import mixed

WINDOW, GRAM = 100, 32
#: Windows of a segment lie at most so far apart.
REACH = WINDOW - GRAM + 1
#: Bytes hashed in one go, and bytes of a shard sorted in one go.
HASHED, SORTED = 1 << 20, 3 << 20
#: One document in so many is looked at for anchors that hold more than 1 / ``HOT`` of the sample;
#: there can be no more than ``HOT`` of them. Neighbouring windows dealt out together then.
SAMPLE, HOT, CLASS = 16, 10_000, 8
NO_ID = (1 << 63) - 1
#: A key whose open segments exceed so many bytes is dealt out again, a window at a time.
LARGE = 16 << 20
SEGMENT, PLACE = "key long, own long, doc long, place long, again boolean", "doc long, place long"


def packed(start: np.ndarray, span: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Place of a run of windows: first start, their number less one, 16 bits of the text's hash."""
    return (start << 24) | (span << 16) | tag


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return place >> 24, (place >> 16) & 255, place & 65535


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes at each place, by doubling."""
    h, size, factor = mixed(raw.astype(np.uint64), 7), 1, 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * np.uint64(factor) + h[size:]
            size, factor = 2 * size, factor * factor % (1 << 64)
    return mixed(h, 11)


def segments(raw: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor: anchor hash, its place, first window, number of windows.

    ``left``: bytes from each place to the end of its text; windows do not cross it.
    """
    none = np.zeros(0, np.int64)
    if len(raw) < WINDOW:
        return none.astype(np.uint64), none, none, none
    grams = gram_hashes(raw)
    order = np.uint64(24)
    least = (grams >> order << order) | np.arange(len(grams), dtype=np.uint64)
    size = 1
    while 2 * size <= REACH:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < REACH:
        least = np.minimum(least[: len(least) - (REACH - size)], least[REACH - size :])
    anchor = (least & np.uint64((1 << 24) - 1)).astype(np.int64)
    anchor[left[: len(anchor)] < WINDOW] = -1
    first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    count = np.diff(np.append(first, len(anchor)))
    real = anchor[first] >= 0
    first, count = first[real], count[real]
    return grams[anchor[first]], anchor[first], first, count


def chunks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """(doc, tag, base, bytes) of texts, long ones in parts that overlap by a window less one byte, some at a time."""
    held, size = [], 0
    for doc, tag, raw in rows:
        for base in range(0, max(1, len(raw) - WINDOW + 1), HASHED):
            part = raw[base : base + HASHED + WINDOW - 1]
            held.append((doc, tag, base, part))
            size += len(part)
            if size >= HASHED:
                yield held
                held, size = [], 0
    if held:
        yield held


def texts(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for b in source:
        for doc, text in zip(b.column(0), b.column(1)):
            raw = (text.as_py() or "").encode()
            doc = doc.as_py()
            yield NO_ID if doc is None else doc, xxhash.xxh64_intdigest(raw) & 65535, raw


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _refined(data: bytes, anchor: np.ndarray, first: np.ndarray, count: np.ndarray, hashes: np.ndarray, hot: np.ndarray):
    """Segments of hot anchors cut into runs of windows by their distance to the anchor, each with a hash of what they share."""
    cold = ~np.isin(hashes, hot)
    if cold.all():
        return hashes, first, count
    keys, firsts, counts = [], [], []
    for k in np.flatnonzero(~cold):
        at, end = int(first[k]), int(first[k] + count[k])
        while at < end:
            group = (int(anchor[k]) - at) // CLASS
            stop = min(end, int(anchor[k]) - group * CLASS + 1)
            shared = data[anchor[k] - group * CLASS : anchor[k] - group * CLASS - CLASS + 1 + WINDOW]
            keys.append(xxhash.xxh64_intdigest(shared, group))
            firsts.append(at)
            counts.append(stop - at)
            at = stop
    return (
        np.concatenate([hashes[cold], np.array(keys, np.uint64)]),
        np.concatenate([first[cold], np.array(firsts, np.int64)]),
        np.concatenate([count[cold], np.array(counts, np.int64)]),
    )


def _hash_segments(hot: np.ndarray, schema: pa.Schema):
    """Rows of the segments: the first of equal ones in each chunk; the others are known to be covered (``again``)
    and only pass by, under keys that spread them over all tasks."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in chunks(texts(source)):
            data = b"".join(part for *_, part in some)
            sizes = np.array([len(part) for *_, part in some])
            ends = np.cumsum(sizes)
            left = np.repeat(ends, sizes) - np.arange(len(data))
            hashes, anchor, first, count = segments(np.frombuffer(data, np.uint8), left)
            key, first, count = _refined(data, anchor, first, count, hashes, hot)
            text = np.searchsorted(ends, first, side="right")
            docs = np.array([x[0] for x in some], np.int64)[text]
            tags = np.array([x[1] for x in some], np.int64)[text]
            bases = np.array([x[2] for x in some], np.int64)[text]
            start = first - (ends - sizes)[text] + bases
            own = np.array([xxhash.xxh64_intdigest(data[a:b]) for a, b in zip(first.tolist(), (first + count + WINDOW - 1).tolist())], np.uint64)
            place = packed(start, count - 1, tags)
            order = np.lexsort((place, docs, own, key))
            key, own, docs, place = key[order], own[order], docs[order], place[order]
            again = np.concatenate([[False], (key[1:] == key[:-1]) & (own[1:] == own[:-1])]) if len(key) else np.zeros(0, bool)
            # Rows that repeat an id stand at the same place: neither is earlier.
            lead = np.maximum.accumulate(np.where(again, 0, np.arange(len(key))))
            again &= ~((docs == docs[lead]) & (place >> 24 == place[lead] >> 24))
            key = np.where(again, mixed(docs.view(np.uint64) ^ mixed(place.view(np.uint64), 1), 2), key)
            columns = [pa.array(c, pa.int64()) for c in (_signed(key), _signed(own), docs, place)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(again, pa.bool_())], schema=schema)

    return run


def _by_key(source: Iterator[pa.RecordBatch], least_rows: int = 1) -> Iterator[pa.Table]:
    """Tables of whole keys (``key`` first, the rows come sorted by it), of ``least_rows`` rows or more but for the last."""
    rest: list[pa.RecordBatch] = []
    count = 0
    for b in source:
        if not b.num_rows:
            continue
        rest.append(b)
        count += b.num_rows
        if count < least_rows:
            continue
        table = pa.Table.from_batches(rest)
        keys = table.column(0).to_numpy()
        cut = int(np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))[-1])
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
        rest, count = table.to_batches(), table.num_rows
    if rest:
        yield pa.Table.from_batches(rest)


def _meet(schema: pa.Schema):
    """Of the segments of each key: places of those equal to an earlier one, and the others where they differ.

    A key's rows are read in order and never held together: whether it has several different
    segments is known from its first and any other one.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # key, segment, doc, start of the first one, and of the key: row of its first, if not yet told
        for b in source:
            key, own, docs, place = (b.column(c).to_numpy().astype(np.int64) for c in range(4))
            again = b.column(4).to_numpy(zero_copy_only=False)
            if again.any():
                yield _rows(schema, key[again], docs[again], place[again], 0)
                key, own, docs, place = key[~again], own[~again], docs[~again], place[~again]
            if not len(key):
                continue
            if last is not None:  # the row before this batch decides how it goes on
                key, own = np.append(last[0], key), np.append(last[1], own)
                docs, place = np.append(last[2], docs), np.append(last[3], place)
            n = len(key)
            same_key = np.concatenate([[False], key[1:] == key[:-1]])
            same = same_key & np.concatenate([[False], own[1:] == own[:-1]])
            lead = np.maximum.accumulate(np.where(same, 0, np.arange(n)))
            tie = (docs == docs[lead]) & (place >> 24 == place[lead] >> 24)
            covered = same & ~tie
            heads = np.flatnonzero(~same)
            key_start = ~same_key
            # A key is open once a second segment follows; its first one is told then.
            open_ = np.zeros(n, bool)
            later = heads[~key_start[heads]]
            open_[later] = True
            group = np.cumsum(key_start) - 1
            several = np.zeros(group[-1] + 1, bool)
            several[group[later]] = True
            told = last[4] if last is not None else False
            firsts = np.flatnonzero(key_start)
            open_[firsts] = several[group[firsts]]
            if last is not None:
                open_[0] = False
                covered[0] = False
                if several[0] and not told:  # the held key's first segment, whose row went by
                    yield _rows(schema, [last[0]], [last[5]], [last[6]], 1)
                told = told or bool(several[0])
            yield _rows(schema, key[covered], docs[covered], place[covered], 0)
            yield _rows(schema, key[open_], docs[open_], place[open_], 1)
            in_last = group[-1]
            at = int(lead[-1])
            first_of_key = int(firsts[-1])
            if last is not None and in_last == 0:
                kept = (told, last[5], last[6])
            else:
                kept = (bool(several[in_last]), docs[first_of_key], place[first_of_key])
            last = (key[-1], own[-1], docs[at], place[at], *kept)

    return run


def _rows(schema: pa.Schema, key, docs, place, kind: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(key, pa.int64()), pa.array(docs, pa.int64()), pa.array(place, pa.int64()), pa.array([kind] * len(key), pa.int32())],
        schema=schema,
    )


def covered_windows(raw: list[bytes], keys: np.ndarray, docs: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (doc, runs of windows) that start later than an equal window, of segments sorted together."""
    data = b"\0".join(raw)
    sizes = np.array([len(x) for x in raw])
    text = np.concatenate([np.frombuffer(data, np.uint8).astype(np.int64) + 2, [1, 0]])
    begins = np.cumsum(sizes + 1) - sizes - 1
    text[begins[1:] - 1] = 1
    order, shared = suffix_array(text, WINDOW)
    segment = np.searchsorted(begins, order, side="right") - 1
    inside = (segment >= 0) & (order - begins[segment] + WINDOW <= sizes[segment])
    # What valid suffixes share with each other is the least of what lies between; those between that are
    # not valid share less than a window with any of them, so that they end a group by themselves.
    group = np.cumsum(shared < WINDOW)[inside]
    order, segment = order[inside], segment[inside]
    start, _, tag = unpacked(places[segment])
    start = start + order - begins[segment]
    # Equal windows of different keys cannot be, but for a hash that two strings share: keep them apart.
    rank = np.lexsort((tag, start, docs[segment], keys[segment], group))
    group, segment, start, tag = group[rank], segment[rank], start[rank], tag[rank]
    own, key = docs[segment], keys[segment]
    head = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])]) if len(group) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(group)), 0))
    late = ~((own == own[lead]) & (start == start[lead]))
    own, start, tag, segment = own[late], start[late], tag[late], segment[late]
    rank = np.lexsort((start, segment))
    own, start, tag, segment = own[rank], start[rank], tag[rank], segment[rank]
    joined = np.concatenate([[False], (segment[1:] == segment[:-1]) & (start[1:] == start[:-1] + 1)]) if len(own) else np.zeros(0, bool)
    head = np.flatnonzero(~joined)
    span = np.diff(np.append(head, len(own))) - 1
    return own[head], packed(start[head], span, tag[head])


def _sort_shards(schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sized(tables: Iterator[pa.Table]) -> Iterator[pa.Table]:
            held, size = [], 0
            for table in tables:
                held.append(table)
                size += table.nbytes
                if size >= SORTED:
                    yield pa.concat_tables(held)
                    held, size = [], 0
            if held:
                yield pa.concat_tables(held)

        for table in sized(_by_key(source, 1000)):
            keys, docs, places = (table.column(c).to_numpy().astype(np.int64) for c in range(3))
            own, place = covered_windows(table.column(3).to_pylist(), keys, docs, places)
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(place, pa.int64())], schema=schema)

    return run


def _fetch(schema: pa.Schema):
    """Bytes of the open segments of each document."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in source:
                for doc, text, wanted in zip(*b.columns):
                    raw = (text.as_py() or "").encode()
                    tag, doc = xxhash.xxh64_intdigest(raw) & 65535, doc.as_py()
                    for w in wanted.as_py():
                        start, span, own = unpacked(w["place"])
                        if own == tag:
                            yield w["key"], doc, w["place"], raw[start : start + span + WINDOW]

        yield from batches(rows(), schema, 32)

    return run


SINGLE = "high long, low long, doc long, place long"


def _single(schema: pa.Schema):
    """Every window of the wanted segments with its 128-bit hash, which is what its equals meet by."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in source:
                for doc, text, wanted in zip(*b.columns):
                    raw = (text.as_py() or "").encode()
                    tag, doc = xxhash.xxh64_intdigest(raw) & 65535, doc.as_py()
                    for w in wanted.as_py():
                        start, span, own = unpacked(w["place"])
                        for at in range(start, start + span + 1) if own == tag else ():
                            h = xxhash.xxh3_128_intdigest(raw[at : at + WINDOW])
                            high, low = np.array([h >> 64, h & ((1 << 64) - 1)], np.uint64).view(np.int64).tolist()
                            yield high, low, doc, at << 24 | own

        yield from batches(rows(), schema, 32)

    return run


def spans_of(places: list[int], tag: int, size: int) -> list[tuple[int, int]]:
    """Covered stretches (begin, end) of a text, joined where they touch."""
    start, span, own = unpacked(np.array(places, np.int64))
    start, span = start[own == tag], span[own == tag]
    order = np.argsort(start, kind="stable")
    begin, end = start[order], np.maximum.accumulate((start + span + WINDOW)[order]) if len(order) else start
    head = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else begin
    last = np.append(head[1:], len(begin)) - 1
    return [(int(a), int(min(b, size))) for a, b in zip(begin[head], end[last.astype(np.int64)])]


def _cut(schema: pa.Schema):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in source:
                for doc, text, places in zip(*b.columns):
                    raw, places = (text.as_py() or "").encode(), places.as_py()
                    spans = spans_of(places, xxhash.xxh64_intdigest(raw) & 65535, len(raw)) if places else []
                    edges = [0, *(x for s in spans for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    doc = doc.as_py()
                    yield None if doc == NO_ID else doc, len(raw), [{"begin": a, "end": b} for a, b in spans], kept

        yield from batches(rows(), schema)

    return run


def hot_anchors(docs: DataFrame) -> np.ndarray:
    """Anchors that hold more than 1 / ``HOT`` of the segments of every ``SAMPLE``-th document, by hash."""
    drawn = docs.filter(F.pmod(F.xxhash64("doc", "text"), F.lit(SAMPLE)) == 0)
    keys = drawn.mapInArrow(_hash_segments(np.zeros(0, np.uint64), arrow_schema(SEGMENT)), SEGMENT).filter("not again").select("key")
    share = max(64, keys.count() // HOT)
    found = keys.groupBy("key").count().filter(F.col("count") > share).select("key").collect()
    return np.array([r[0] for r in found], np.int64).view(np.uint64)


def remove_repeats(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, ``spans`` (begin, end of what goes) and ``kept`` (the bytes left).

    Texts are UTF-8 bytes. A missing text is empty; a missing id comes after all others. Rows that
    repeat an id have places in common: of two equal strings at one place of them neither is
    earlier. Ids are whole numbers. Other columns are ignored.
    """
    kind = type_of(docs, id_col)
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc"), F.col(f"`{text_col}`").alias("text"))
    hot = hot_anchors(rows)
    order = ["key", "own", "doc", "place"]
    hashed = rows.mapInArrow(_hash_segments(hot, arrow_schema(SEGMENT)), SEGMENT)
    told = "key long, doc long, place long, kind int"
    met = staged(
        hashed.repartition("key").sortWithinPartitions(*order).mapInArrow(_meet(arrow_schema(told)), told), f"{folder}/met"
    )
    open_ = met.filter("kind = 1")
    size = F.sum(F.expr("(shiftright(place, 16) & 255)") + WINDOW)
    large = staged(open_.groupBy("key").agg(size.alias("size")).filter(F.col("size") > LARGE).select("key"), f"{folder}/large")

    def texts_of(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("doc").agg(F.collect_list(F.struct("key", "place")).alias("wanted"))
        return rows.join(wanted, "doc").select("doc", "text", "wanted")

    bytes_ = "key long, doc long, place long, raw binary"
    has_large = bool(large.take(1))
    fetched = texts_of(open_.join(large, "key", "left_anti") if has_large else open_).mapInArrow(_fetch(arrow_schema(bytes_)), bytes_)
    sorted_ = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(_sort_shards(arrow_schema(PLACE)), PLACE)
    covered = sorted_.unionByName(met.filter("kind = 0").select("doc", "place"))
    if has_large:
        single = texts_of(open_.join(large, "key", "left_semi")).mapInArrow(_single(arrow_schema(SINGLE)), SINGLE)
        single = staged(single, f"{folder}/single").withColumn("start", F.expr("shiftright(place, 24)"))
        first = single.groupBy("high", "low").agg(F.min(F.struct("doc", "start")).alias("first"))
        late = single.join(first, ["high", "low"]).filter(F.struct("doc", "start") > F.col("first"))
        covered = covered.unionByName(late.select("doc", "place"))
    by_doc = covered.groupBy("doc").agg(F.collect_list("place").alias("places"))
    result = f"doc_id {kind}, n_bytes long, spans array<struct<begin:long,end:long>>, kept binary"
    joined = rows.join(by_doc, "doc", "left").select("doc", "text", "places")
    return joined.mapInArrow(_cut(arrow_schema(result)), result)
