"""SentencePiece encoding and decoding with an Aho-Corasick automaton and one Viterbi pass.

The automaton of all pieces reads a text once; at each position it follows its output links to
every piece that ends there, longest first, and each of them relaxes the best score of the
position. What a score is, the model says:

* unigram: the sum of the pieces' scores, the larger the better;
* merges (BPE): minus the number of neighbours that the merges would not have left side by side.
  A text has exactly one cut without such neighbours, the one the merges make, so that a position
  keeps the piece with which a clean cut of the text before it ends, if any.

Pieces hold white space only in front, so a text falls into words whose cuts do not depend on
each other; the cut of a word is remembered. Characters that no piece has become bytes.
"""

from __future__ import annotations

import heapq
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from tidemark.llm.frames import arrow_schema, batches, narrowed, pairs, type_of
from tidemark.llm.tokens import ENTRY_BYTES, ID

SPACE = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: How much less than the worst piece an unknown character scores.
UNKNOWN_PENALTY = 10.0
#: Bytes that the memos of a worker may take, pairs of pieces included; about what a pair takes.
MEMO_BYTES, PAIR_BYTES = 220_000_000, 200
#: Words from this length on are cut with four bytes a place.
LONG = 1 << 12
#: Whether an array of C integers has the bytes of the ids.
SMALL_ENDIAN = sys.byteorder == "little" and array("I").itemsize == ID.itemsize


class Pieces:
    def __init__(self, model: bytes, memo_bytes: int = MEMO_BYTES) -> None:
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        rules, training = proto.normalizer_spec, proto.trainer_spec
        if training.model_type not in (UNIGRAM, BPE):
            raise ValueError("the model is neither a unigram nor a merge model")
        if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.escape_whitespaces:
            raise ValueError("only models that take texts as they are can be used")
        self.merges = training.model_type == BPE
        self.prefix = rules.add_dummy_prefix
        self.spelling = [p.piece for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.byte_ids = {int(p.piece[3:5], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.bytes = {k: bytes([b]) for b, k in self.byte_ids.items()}
        self.hidden = {k for k, p in enumerate(proto.pieces) if p.type not in (NORMAL, USER_DEFINED, BYTE)}
        self.unknown = next((k for k, p in enumerate(proto.pieces) if p.type == 2), 0)
        self.known = {p.piece: k for k, p in enumerate(proto.pieces) if p.type in (NORMAL, USER_DEFINED)}
        if any(p.type == USER_DEFINED for p in proto.pieces):
            raise ValueError("models with pieces of a user's own are not supported")
        self.automaton = ahocorasick.Automaton()
        for piece, k in self.known.items():
            self.automaton.add_word(piece, (len(piece), k))
        self.automaton.make_automaton()
        self.worst = min((self.scores[k] for k in self.known.values()), default=0.0) - UNKNOWN_PENALTY
        inner = re.compile(f"[^{SPACE}]{SPACE}")
        self.by_word = not any(inner.search(p) for p in self.known)
        self._words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self._letters = frozenset(p for p in self.known if len(p) == 1)
        self._score = {p: -self.scores[k] for p, k in self.known.items()}
        #: What each id stands for in a text, white space not yet put back.
        self._raw = [self.bytes.get(k) or (b"" if k in self.hidden else p.encode()) for k, p in enumerate(self.spelling)]
        #: By the left piece, -1 for none, times the number of pieces, plus the right piece.
        self._beside: dict[int, bool] = {}
        self._memo: dict[str, bytes] = {}
        self.memo_bytes, self._held = memo_bytes, 0

    def merged(self, text: str) -> list[str]:
        """Pieces that the merges leave of a short string: best score first, leftmost first."""
        parts, score = list(text), self._score.get
        costs = [score(a + b, np.inf) for a, b in zip(parts, parts[1:])]
        while costs:
            least = min(costs)
            if least == np.inf:
                break
            k = costs.index(least)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del costs[k]
            if k:
                costs[k - 1] = score(parts[k - 1] + parts[k], np.inf)
            if k < len(costs):
                costs[k] = score(parts[k] + parts[k + 1], np.inf)
        return parts

    def beside(self, left: int | None, right: int) -> bool:
        """Whether the merges leave these two pieces side by side; no left piece: the right one whole."""
        pair = (-1 if left is None else left) * len(self.spelling) + right
        found = self._beside.get(pair)
        if found is None:
            if len(self._beside) * PAIR_BYTES > self.memo_bytes // 2:  # one word may hold any number of pairs
                self._held -= len(self._beside) * PAIR_BYTES
                self._beside.clear()
            own = [self.spelling[k] for k in (left, right) if k is not None]
            self._beside[pair] = found = self.merged("".join(own)) == own
            self._held += PAIR_BYTES
        return found

    def edges(self, word: str) -> Iterable[tuple[int, tuple[int, int | None]]]:
        """(last place, (length, piece)) of every piece in the word and every unknown character, by place, as the automaton walks."""
        found = self.automaton.iter(word)
        if self._letters.issuperset(word):
            return found
        return heapq.merge(found, ((k, (1, None)) for k, c in enumerate(word) if c not in self.known), key=lambda e: e[0])

    def cut(self, word: str) -> list[int | None]:
        """Pieces of the best cut; None for a character that has none."""
        n = len(word)
        # Of each place: the length of the piece that ends there in the best cut, and the piece, -1 for none.
        sizes, pieces = ([0] * (n + 1), [-1] * (n + 1)) if n < LONG else (array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1))
        if self.merges:
            clean = bytearray(n + 1)
            clean[0] = 1
            known, count = self._beside.get, len(self.spelling)
            for end, (size, piece) in self.edges(word):
                end += 1
                if clean[end] or not clean[end - size]:
                    continue
                if piece is None:
                    clean[end] = sizes[end] = 1
                    continue
                left = pieces[end - size]
                beside = known(left * count + piece)
                if beside is None:
                    beside = self.beside(None if left < 0 else left, piece)
                if beside:
                    clean[end], sizes[end], pieces[end] = 1, size, piece
        else:
            best = array("d", [-np.inf]) * (n + 1)
            best[0] = 0.0
            for end, (size, piece) in self.edges(word):
                start = end + 1 - size
                score = best[start] + (self.worst if piece is None else self.scores[piece])
                if score > best[end + 1]:
                    best[end + 1], sizes[end + 1], pieces[end + 1] = score, size, -1 if piece is None else piece
        cut: list[int | None] = []
        while n:
            cut.append(None if pieces[n] < 0 else pieces[n])
            n -= sizes[n]
        return cut[::-1]

    def word(self, word: str) -> bytes:
        cut = self.cut(word)
        if None not in cut:
            return array("I", cut).tobytes() if SMALL_ENDIAN else np.array(cut, ID).tobytes()
        ids: list[int] = []
        at = 0
        for piece in cut:
            size = 1 if piece is None else len(self.spelling[piece])
            if piece is not None:
                ids.append(piece)
            elif self.byte_ids:
                ids += [self.byte_ids[b] for b in word[at].encode()]
            elif ids[-1:] != [self.unknown]:
                ids.append(self.unknown)
            at += size
        return np.array(ids, ID).tobytes()

    def encode(self, text: str | None) -> bytes:
        """Ids of the text as little-endian 32-bit integers; a missing text is an empty one."""
        if not text:
            return b""
        text = (SPACE if self.prefix else "") + text.replace(" ", SPACE)
        if not self.by_word:
            return self.word(text)
        words = self._words.findall(text)
        memo = self._memo
        new = set(words).difference(memo)
        if self._held + sum(map(len, new)) > self.memo_bytes:
            memo.clear()
            self._beside.clear()
            self._held, new = 0, set(words)
        for w in new:
            memo[w] = ids = self.word(w)
            self._held += ENTRY_BYTES + len(w) + len(ids)
        return b"".join(map(memo.__getitem__, words))

    def decode(self, ids: bytes) -> str:
        raw = b"".join(map(self._raw.__getitem__, np.frombuffer(ids, ID).tolist()))
        text = raw.decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def pieces(path: str) -> Pieces:
    """One automaton for each model file and worker."""
    with open(path, "rb") as source:
        return Pieces(source.read())


def _per_row(docs: DataFrame, model: str, id_col: str, column: str, result: str, convert) -> DataFrame:
    rows = narrowed(docs, id_col, column)
    result = f"doc_id {type_of(rows, 'doc_id')}, {result}"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)
        yield from batches(((i, convert(own, x)) for i, x in pairs(source)), schema)

    return rows.mapInArrow(run, result)


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``ids`` (binary, little-endian 32 bit) of every row.

    A missing or empty text has no ids; repeated rows and missing ids give a row each; other
    columns are ignored.
    """
    return _per_row(docs, model, id_col, text_col, "ids binary", lambda own, x: own.encode(x))


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and ``text`` of every row; missing ids give a missing text."""
    return _per_row(encoded, model, id_col, ids_col, "text string", lambda own, x: None if x is None else own.decode(x))


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ``n_ids``, ``ids_crc32`` and ``same``: whether the decoded ids are the text again.

    A missing or empty text has no ids and is the same; repeated rows and missing ids give a row each.
    """
    rows = narrowed(docs, id_col, text_col)
    result = f"doc_id {type_of(rows, 'doc_id')}, ids binary, same boolean"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pieces(model)

        def out() -> Iterator[tuple]:
            for doc_id, text in pairs(source):
                ids = own.encode(text)
                yield doc_id, ids, own.decode(ids) == (text or "")

        yield from batches(out(), schema)

    return rows.mapInArrow(run, result).select(
        "doc_id", (F.length("ids") / ID.itemsize).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "same"
    )
