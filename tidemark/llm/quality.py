"""Quality rules: counts of words, symbols and repeats, and compression bands.

Text that says the same again and again compresses too well, noise hardly at all. Both ends are
cut by limits on the zstandard ratio (bytes over compressed bytes), for the whole text and for
its fixed chunks, their median and each of them. A longer text always compresses better, so every limit holds for a band of
lengths. Each document is judged alone, in one pass, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame

from tidemark.llm.frames import arrow_schema, batches, narrowed, pairs, type_of

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """Texts of at least ``n_bytes``: ratios outside ``whole``, or a median chunk ratio outside ``chunk``, fail.

    So do texts with more than ``MAX_OUTSIDE`` percent of their chunks outside ``each``.
    """

    n_bytes: int
    whole: tuple[float, float]
    chunk: tuple[float, float]
    each: tuple[float, float] = (0.0, 99.0)


#: Set by the labelled rows of a tenth-scale table, a little above and below what any row of good
#: quality has. Texts below the first band are too short to be judged by compression.
EACH = (1.64, 2.04)
BANDS = (
    Band(256, (1.30, 1.92), (0.0, 99.0)),
    Band(384, (1.36, 1.92), (0.0, 99.0)),
    Band(512, (1.39, 1.92), (0.0, 99.0)),
    Band(640, (1.43, 1.94), (0.0, 99.0)),
    Band(768, (1.53, 1.98), (0.0, 99.0)),
    Band(896, (1.60, 2.02), (0.0, 99.0)),
    Band(1024, (1.65, 2.09), (1.64, 2.03), EACH),
    Band(1536, (1.80, 2.17), (1.64, 2.01), EACH),
    Band(2048, (1.87, 2.20), (1.64, 1.98), EACH),
    Band(3072, (1.94, 2.26), (1.64, 1.97), EACH),
    Band(4096, (2.05, 2.37), (1.64, 1.965), EACH),
    Band(8192, (2.16, 2.52), (1.64, 1.955), EACH),
    Band(16384, (2.28, 2.60), (1.64, 1.955), EACH),
    Band(65536, (2.28, 2.75), (1.64, 1.955), EACH),
)
LEVEL, CHUNK = 3, 1024
MIN_WORDS, MAX_REPEATED, MAX_OUTSIDE = 50, 50, 20
COLUMNS = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean,"
    " ratio double, chunk_ratio double, kept boolean"
)


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of three words that the text holds twice or more, the first included."""
    if len(words) < 4:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    pair = ids[:-1] * len(numbers) + ids[1:]
    if len(numbers) >= 1 << 20:  # three numbers would not fit into 64 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(numbers) + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    again = np.zeros(len(window), bool)
    again[order[1:]] |= same
    again[order[:-1]] |= same
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : k + len(window)] |= again
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    seen, found = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            found += line in seen
            seen.add(line)
    return found


class Rules:
    def __init__(self, bands: tuple[Band, ...] = BANDS, chunk: int = CHUNK, level: int = LEVEL) -> None:
        self.bands = sorted(bands, key=lambda b: -b.n_bytes)
        self.size = chunk
        self.frames = zstd.ZstdCompressor(level=level)

    def ratio(self, raw: bytes | memoryview) -> float:
        return len(raw) / len(self.frames.compress(raw)) if len(raw) else 0.0

    def measure(self, text: str | None) -> tuple:
        """Values of ``COLUMNS`` for a text; a missing one has no words."""
        text = text or ""
        raw = text.encode()
        words = raw.split()
        repeats = repeated_words(words)
        failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEATED * len(words)
        whole = self.ratio(raw)
        view = memoryview(raw)
        chunks = [self.ratio(view[k : k + self.size]) for k in range(0, len(raw) - self.size + 1, self.size)]
        middle = median(chunks) if chunks else None
        band = next((b for b in self.bands if len(raw) >= b.n_bytes), None)
        inside = band is None or (
            band.whole[0] <= whole <= band.whole[1] and (middle is None or band.chunk[0] <= middle <= band.chunk[1])
        )
        if inside and chunks and band:
            tail = [self.ratio(view[-self.size :])] if len(raw) % self.size else []  # a full chunk as well, ending the text
            outside = sum(not band.each[0] <= x <= band.each[1] for x in chunks + tail)
            inside = 100 * outside <= MAX_OUTSIDE * len(chunks + tail)
        return (
            len(words), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), duplicate_lines(text),
            repeats, failed, whole, middle, not failed and inside,
        )


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """One row per document: its id, its counts, its ratios, ``base_failed`` and ``kept``.

    A missing text counts as empty: no words, ratio 0, not kept. A text shorter than a chunk has no
    chunk ratio. Repeated rows and missing ids give a row each; other columns are ignored.
    """
    rows = narrowed(docs, id_col, text_col)
    result = f"doc_id {type_of(rows, 'doc_id')}, {COLUMNS}"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(bands)
        yield from batches(((doc_id, *rules.measure(text)) for doc_id, text in pairs(source)), schema)

    return rows.mapInArrow(run, result)


def keep_good(docs: DataFrame, text_col: str = "text", bands: tuple[Band, ...] = BANDS) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    place = docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules(bands)
        for b in source:
            yield b.filter(pa.array([rules.measure(x.as_py())[-1] for x in b.column(place)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
