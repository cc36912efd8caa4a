"""Words covered by a long window of words that an earlier document holds, found by super-k-mer partitioning.

A window is ``WINDOW`` consecutive words. Of the ``GRAM``-word strings inside it the one with the
smallest hash is its minimiser, so equal windows have equal minimisers. Consecutive windows with one
minimiser form a super-k-mer: they travel together, as one string of all their words, to the
minimiser's bucket, where the windows of all its strings are sorted and equal ones counted.

1. Every task cuts its texts into super-k-mers and keeps one row of equal ones per document. Within
   the task's stretch of texts only the smallest document's row leads on, the others are covered.
2. Buckets that a single document reaches hold nothing shared and end here; of equal super-k-mers
   only the smallest document's go on, the others are covered. Both are partial sums and joins of
   rows without text, so a passage that a third of all documents hold costs one row per task.
3. Buckets with several different super-k-mers get their strings. A bucket's windows are sorted by
   hash and every match is compared byte by byte.
4. A bucket whose strings exceed ``BUCKET`` bytes is dealt out again, a window at a time, by the 128-bit
   hash of each window, which needs no string: step 2 once more.
5. Covered windows go back to their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.frames import batches, mapped, staged, type_of, whole_keys
from tidemark.llm.perfect_hash import mixed

WINDOW, GRAM = 50, 8
#: Bytes of text cut up in one go, of packed strings sorted in one go, and of a bucket that is sorted as one.
CUT, SORTED, BUCKET = 1 << 20, 8 << 20, 16 << 20
NO_ID = (1 << 63) - 1
BLANK = re.compile(rb"[\x20\x09-\x0D]")
GAPS = np.zeros(256, bool)
GAPS[[0x20, *range(0x09, 0x0E)]] = True
#: A value for every byte and the base of the rolling hash.
VALUES, BASE = mixed(np.arange(256, dtype=np.uint64), 3), 0x9E3779B97F4A7C15
RUN = "key long, own long, doc long, h long, lead boolean, n int, size long, places array<int>"
MARK = "doc long, h long, n int, places array<int>"
PACKED = "key long, packed binary, doc long, h long, places array<int>"

INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The base to the power of 0 to n - 1, modulo 2^64."""
    if len(_powers.get(base, ())) < n:
        steps = np.full(n, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base][:n]


def word_begins(gap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(~gap & np.concatenate([[True], gap[:-1]]))


class Words:
    """Words of some texts: their bytes with one blank behind each, where each begins and ends, and its text."""

    def __init__(self, texts: list[bytes]) -> None:
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        gap = GAPS[raw]
        after = np.concatenate([[True], gap[:-1]])
        begins, ends = word_begins(gap), np.flatnonzero(gap & ~after)
        keep = ~(gap & after)
        place = np.cumsum(keep) - 1
        self.raw = np.where(gap, np.uint8(0x20), raw)[keep]
        self.begins, self.ends = place[begins], place[ends]
        self.text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), begins, side="right")
        self._sums: np.ndarray | None = None

    def hashes(self, first: np.ndarray, size: int) -> np.ndarray:
        """Hash of ``size`` words from each of these on, by prefix sums of a polynomial."""
        n = len(self.raw)
        if self._sums is None:
            self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[self.raw] * powers(BASE, n))])
        begin, end = self.begins[first], self.ends[first + size - 1]
        return mixed((self._sums[end] - self._sums[begin]) * powers(INVERSE, n)[begin], 5)

    def windows(self) -> np.ndarray:
        """Numbers of the words that a window of one text starts at."""
        return np.flatnonzero(self.text[: 1 - WINDOW] == self.text[WINDOW - 1 :]) if len(self.text) >= WINDOW else self.text[:0]

    def bytes_of(self, first: int, windows: int) -> bytes:
        return self.raw[self.begins[first] : self.ends[first + windows + WINDOW - 2]].tobytes()


def super_kmers(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimiser hash, first window and number of windows of each run of windows with one minimiser."""
    windows = words.windows()
    if not len(windows):
        return np.zeros(0, np.uint64), windows, windows
    grams = words.hashes(np.arange(len(words.begins) - GRAM + 1), GRAM)
    low = np.uint64(24)
    least = (grams >> low << low) | np.arange(len(grams), dtype=np.uint64)
    reach, size = WINDOW - GRAM + 1, 1
    while 2 * size <= reach:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < reach:
        least = np.minimum(least[: len(least) - (reach - size)], least[reach - size :])
    place = (least & np.uint64((1 << 24) - 1)).astype(np.int64)[windows]
    heads = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (windows[1:] != windows[:-1] + 1)]))
    return grams[place[heads]], windows[heads], np.diff(np.append(heads, len(windows)))


def pieces(raw: bytes, overlap: int) -> Iterator[tuple[int, bytes]]:
    """(number of its first word, bytes) of stretches of whole words; each but the first begins with the last ``overlap`` words before it."""
    at = number = 0
    size = CUT
    while at + size < len(raw):
        found = BLANK.search(raw, at + size)
        part = raw[at : found.start() if found else len(raw)]
        begins = word_begins(GAPS[np.frombuffer(part, np.uint8)])
        step = len(begins) - overlap
        if step <= overlap:  # few and very long words
            size *= 2
            continue
        yield number, part
        number, at, size = number + step, at + (int(begins[step]) if overlap else len(part)), CUT
    yield number, raw[at:]


def chunks(source: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Lists of (doc, h, number of the first word, bytes), some texts at a time, long ones in stretches."""
    held: list[tuple] = []
    size = 0
    for b in source:
        for doc, text, h in zip(b.column(0), b.column(1), b.column(2)):
            for number, part in pieces((text.as_py() or "").encode(), WINDOW - 1):
                held.append((doc.as_py(), h.as_py(), number, part))
                size += len(part)
                if size >= CUT:
                    yield held
                    held, size = [], 0
    if held:
        yield held


def _rows(schema: pa.Schema, some: list[tuple], words: Words, key: np.ndarray, first: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
    """One row per document and run with all its places; ``lead`` if no smaller document here has the same run."""
    begin, end = words.begins[first], words.ends[first + count + WINDOW - 2]
    raw = words.raw.tobytes()
    own = np.array([xxhash.xxh64_intdigest(raw[a:b]) for a, b in zip(begin.tolist(), end.tolist())], np.uint64).view(np.int64)
    text = words.text[first]
    doc, h, base = (np.array([x[k] for x in some], np.int64)[text] for k in range(3))
    start = first - np.searchsorted(words.text, np.arange(len(some)))[text] + base
    order = np.lexsort((start, h, doc, own, key))
    key, own, doc, h, start, count, size = (x[order] for x in (key.view(np.int64), own, doc, h, start, count, end - begin))
    new = np.ones(len(key), bool)
    same_run = (key[1:] == key[:-1]) & (own[1:] == own[:-1])
    same_row = same_run & (doc[1:] == doc[:-1]) & (h[1:] == h[:-1])
    new[1:] = ~(same_row & (start[1:] == start[:-1]))  # rows that repeat an id and its text
    run = np.maximum.accumulate(np.where(np.concatenate([[True], ~same_run]), np.arange(len(key)), 0)) if len(key) else start
    lead = doc == doc[run]
    heads = np.flatnonzero(np.concatenate([[True], ~same_row])) if len(key) else start
    ends = np.append(np.cumsum(new)[heads] - 1, new.sum()) if len(key) else np.zeros(1)
    places = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(start[new], pa.int32()))
    columns = [pa.array(x[heads]) for x in (key, own, doc, h, lead)]
    columns += [pa.array(count[heads], pa.int32()), pa.array(size[heads], pa.int64()), places]
    return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema)], schema=schema)


def _cut_up(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for some in chunks(source):
        words = Words([x[3] for x in some])
        yield _rows(schema, some, words, *super_kmers(words))


def _wanted(source: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """doc, h, number of the first word, words, and the wanted runs of each stretch of a text."""
    for b in source:
        for doc, h, text, wanted in zip(*b.columns):
            wanted = wanted.as_py()
            for number, part in pieces((text.as_py() or "").encode(), WINDOW - 1):
                words = part.split()
                inside, later = [], []
                for w in wanted:
                    (inside if w["places"][0] + w["n"] + WINDOW - 1 <= number + len(words) else later).append(w)
                yield doc.as_py(), h.as_py(), number, words, inside
                wanted = later


def _pack(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The words of the wanted super-k-mers as one string each."""

    def rows() -> Iterator[tuple]:
        for doc, h, number, words, wanted in _wanted(source):
            for w in wanted:
                at = w["places"][0] - number
                yield w["key"], b" ".join(words[at : at + w["n"] + WINDOW - 1]), doc, h, w["places"]

    yield from batches(rows(), schema, 64)


def _single(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The windows of the wanted super-k-mers, each as a run of its own under its hash."""

    def runs() -> Iterator[tuple]:
        for doc, h, number, words, wanted in _wanted(source):
            for w in wanted:
                for place in w["places"]:
                    at = w["places"][0] - number
                    yield doc, h, place, b" ".join(words[at : at + w["n"] + WINDOW - 1])

    def some() -> Iterator[list[tuple]]:
        held, size = [], 0
        for row in runs():
            held.append(row)
            size += len(row[3])
            if size >= CUT:
                yield held
                held, size = [], 0
        if held:
            yield held

    for held in some():
        words = Words([x[3] for x in held])
        first = words.windows()
        yield _rows(schema, held, words, words.hashes(first, WINDOW), first, np.ones(len(first), np.int64))


def late_windows(packed: list[bytes], keys: np.ndarray, docs: np.ndarray) -> list[tuple[int, int, int]]:
    """(string, first window, number of windows) of the windows that a smaller document's string of the same key holds."""
    words = Words(packed)
    first = words.windows()
    if not len(first):
        return []
    h, string = words.hashes(first, WINDOW), words.text[first]
    key, doc = keys[string], docs[string]
    order = np.lexsort((first, doc, h, key))
    head = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])])
    lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
    found = np.zeros(len(order), np.int64)
    found[order] = lead
    late = np.flatnonzero(doc > doc[found])
    lead = found[late]
    at, source = first[late], first[lead]
    goes_on = (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1] + 1) & (string[late][1:] == string[late][:-1])
    goes_on &= string[lead][1:] == string[lead][:-1]
    heads = np.flatnonzero(np.concatenate([[True], ~goes_on])) if len(late) else late
    base = np.searchsorted(words.text, np.arange(len(packed)))
    runs = []
    for k, n in zip(heads.tolist(), np.diff(np.append(heads, len(late))).tolist()):
        if words.bytes_of(at[k], n) != words.bytes_of(source[k], n):
            return list(_by_bytes(packed, keys, docs))  # two strings share a hash
        own = int(string[late[k]])
        runs.append((own, int(at[k] - base[own]), n))
    return runs


def _by_bytes(packed: list[bytes], keys: np.ndarray, docs: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """The same by the windows' bytes."""
    least: dict[tuple, int] = {}
    texts = [p.split() for p in packed]
    for again in (False, True):
        for k, words in enumerate(texts):
            for at in range(len(words) - WINDOW + 1):
                window = (int(keys[k]), b" ".join(words[at : at + WINDOW]))
                if not again:
                    least[window] = min(least.get(window, NO_ID), int(docs[k]))
                elif least[window] < docs[k]:
                    yield k, at, 1


def _count(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for table in whole_keys(source, SORTED):
            keys, docs, h = (table.column(c).to_numpy() for c in ("key", "doc", "h"))
            places = table.column("places").to_pylist()
            for k, at, n in late_windows(table.column("packed").to_pylist(), keys, docs):
                yield int(docs[k]), int(h[k]), n, [p + at for p in places[k]]

    yield from batches(rows(), schema, 48)


def _shared(leads: DataFrame) -> DataFrame:
    """``leads`` whose key another document has as well."""
    keys = leads.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("key")
    return leads.join(keys, "key", "left_semi")


def _firsts(leads: DataFrame) -> DataFrame:
    """Smallest document and bytes of each run."""
    return leads.groupBy("key", "own").agg(F.min("doc").alias("first"), F.max("size").alias("size"))


def _cut_out(source: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Texts without their marked words."""

    def rows() -> Iterator[tuple]:
        for b in source:
            for doc, text, marks in zip(*b.columns):
                doc, marks = doc.as_py(), marks.as_py() or []
                begin = np.array([p for m in marks for p in m["places"]], np.int64)
                end = np.array([p + m["n"] + WINDOW - 1 for m in marks for p in m["places"]], np.int64)
                order = np.argsort(begin, kind="stable")
                begin, end = begin[order], np.maximum.accumulate(end[order]) if len(end) else end
                heads = np.flatnonzero(np.concatenate([[True], begin[1:] > end[:-1]])) if len(begin) else begin
                spans = list(zip(begin[heads].tolist(), end[np.append(heads[1:], len(end)) - 1].tolist())) if len(begin) else []
                count, kept = 0, []
                for number, part in pieces((text.as_py() or "").encode(), 0):
                    words = part.split()
                    count += len(words)
                    at, left = 0, []
                    for a, e in spans:
                        if e > number + at and a < number + len(words):
                            left += words[at : max(at, a - number)]
                            at = e - number
                    left += words[at:]
                    if left:
                        kept.append(b" ".join(left))
                removed = sum(e - a for a, e in spans)
                yield None if doc == NO_ID else doc, count, removed, [{"begin": a, "end": e} for a, e in spans], b" ".join(kept).decode()

    yield from batches(rows(), schema)


def remove_shared_windows(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, ``spans`` (begin, end of removed words) and ``kept`` (the other words, one blank between).

    Words are stretches without ASCII white space. A word goes if a window of 50 words around it also
    starts in a document with a smaller id, whatever else is removed. A missing text has no words; a
    missing id comes after all others, and among rows without one, or with the same one, none is
    smaller: they lose nothing to each other. Repeated rows each give a row. Ids are whole numbers.
    An empty table gives an empty one. Other columns are ignored.
    """
    text = F.col(f"`{text_col}`")
    doc = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)).alias("doc")
    rows = docs.select(doc, text.alias("text"), F.xxhash64(text).alias("h"))
    runs = staged(mapped(rows, _cut_up, RUN), f"{folder}/runs")
    met = staged(_shared(runs.filter("lead")), f"{folder}/met")
    firsts = _firsts(met)
    several = firsts.groupBy("key").agg(F.count(F.lit(1)).alias("different"), F.sum("size").alias("bytes")).filter("different > 1")
    judged = met.join(firsts.drop("size"), ["key", "own"]).join(several.select("key", "bytes"), "key", "left")
    judged = staged(judged.select("key", "doc", "h", "n", "places", "first", "bytes"), f"{folder}/judged")

    def with_text(which: DataFrame) -> DataFrame:
        wanted = which.groupBy("doc", "h").agg(F.collect_set(F.struct("key", "n", "places")).alias("wanted"))
        return rows.join(wanted, ["doc", "h"]).select("doc", "h", "text", "wanted")

    mark = [c.split()[0] for c in MARK.split(", ")]
    open_ = judged.filter("doc = first and bytes is not null")
    packed = mapped(with_text(open_.filter(F.col("bytes") <= BUCKET)), _pack, PACKED)
    counted = mapped(packed.repartition("key").sortWithinPartitions("key"), _count, MARK)
    covered = runs.filter("not lead").select(*mark).unionByName(judged.filter("doc > first").select(*mark)).unionByName(counted)
    large = open_.filter(F.col("bytes") > BUCKET)
    if large.take(1):
        single = staged(mapped(with_text(large), _single, RUN), f"{folder}/single")
        leads = single.filter("lead")
        late = leads.join(_firsts(leads).drop("size"), ["key", "own"]).filter("doc > first")
        covered = covered.unionByName(single.filter("not lead").select(*mark)).unionByName(late.select(*mark))
    marks = covered.groupBy("doc", "h").agg(F.collect_set(F.struct("n", "places")).alias("marks"))
    result = f"doc_id {type_of(docs, id_col)}, n_words long, n_removed long, spans array<struct<begin:long,end:long>>, kept string"
    return mapped(rows.join(marks, ["doc", "h"], "left").select("doc", "text", "marks"), _cut_out, result)
