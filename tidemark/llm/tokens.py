"""Encoding whole texts with a tokenizer file, word by word where that gives the same ids."""

from __future__ import annotations

import string
import struct
from functools import cache

import numpy as np
from tokenizers import Tokenizer

ID = np.dtype("<u4")
#: Bytes that the memo of a worker may take; what an entry takes besides its strings.
MEMO_BYTES, ENTRY_BYTES = 280_000_000, 170
#: Marks that a splitting rule cuts off a word's end, all of them together. An apostrophe may belong to the word.
MARKS, LINE = string.punctuation.replace("'", ""), "\n"


def byte_letters() -> dict[int, int]:
    """Letter that stands for each byte in a byte-level vocabulary: itself if it prints, else one past 255."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    others = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + k for k, b in enumerate(others)}


def pack_ids(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of a text as little-endian 32-bit integers.

    A byte-level vocabulary starts a new word at every single space between two visible
    characters, so such texts are encoded from a memo of their words. Any other text, and any
    tokenizer with another splitting rule, goes through the tokenizer whole. A new word of Latin
    letters is one token of the splitting rule and goes straight to the tokenizer's merges.
    """

    def __init__(self, path: str, memo_bytes: int = MEMO_BYTES) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.by_word = type(self.tokenizer.pre_tokenizer).__name__ == "ByteLevel" and self.tokenizer.normalizer is None
        self.merges = self.tokenizer.model
        self.letters = byte_letters()
        self.space = chr(self.letters[ord(" ")])
        self.memo_bytes = memo_bytes
        self._memo: dict[str, bytes | bool] = {}
        self._starts: dict[str, bytes] = {}
        self._marks: dict[str, bytes] = {}
        self._held = 0
        self.line = self.whole(LINE)

    def whole(self, text: str) -> bytes:
        return pack_ids(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _keep(self, memo: dict, word: str, ids: bytes | bool) -> bytes | bool:
        memo[word] = ids
        self._held += ENTRY_BYTES + len(word) + len(ids or b"")
        return ids

    def _letters(self, run: str) -> bytes:
        """Ids of a run of letters, which may have a space in front."""
        if run.isascii():
            spelled = run.replace(" ", self.space)
        else:
            spelled = run.encode().decode("latin-1").translate(self.letters)
        return pack_ids([t.id for t in self.merges.tokenize(spelled)])

    def _run(self, run: str, core: str) -> bytes:
        """Ids of a run of letters, ``core``, after a space or nothing, and of the marks behind it."""
        if not core.isalpha() or not core.isascii() and max(core) > "\u024f":
            return self.whole(run)
        spaced = run[0] == " "
        bare = " " + core if spaced else core
        marks = run[len(bare) :]
        if not marks and spaced:
            return self._letters(bare)
        memo = self._memo if spaced else self._starts
        ids = memo.get(core)
        if ids is None:
            ids = self._keep(memo, core, self._letters(bare))
        if not marks:
            return ids
        end = self._marks.get(marks)
        if end is None:
            end = self.whole(marks)
            if len(marks) <= 3:
                self._marks[marks] = end
        return ids + end

    def _word(self, word: str) -> bytes | bool:
        """Ids of a space and the word; False for a word that touches other white space.

        A single line break between visible characters is a token of its own.
        """
        if LINE not in word and word and not word[0].isspace() and not word[-1].isspace():
            return self._run(" " + word, word.rstrip(MARKS))
        first, *lines = word.split(LINE)
        if any(not p or p[0].isspace() or p[-1].isspace() for p in (first, *lines)):
            ragged = not word or word[0].isspace() or word[-1].isspace()
            return False if ragged else self.whole(" " + word)
        ids = self._run(" " + first, first.rstrip(MARKS))
        for line in lines:
            ids += self.line + self._run(line, line.rstrip(MARKS))
        return ids

    def ids(self, text: str | None) -> bytes:
        """Ids of ``text``; a missing text is an empty one."""
        if not text:
            return b""
        first, *rest = text.split(" ")
        if not self.by_word or first[-1:].isspace():
            return self.whole(text)
        memo = self._memo
        if self._held > self.memo_bytes:
            memo.clear()
            self._starts.clear()
            self._held = 0
        parts = list(map(memo.get, rest))
        if None in parts:
            for k, part in enumerate(parts):
                if part is None:
                    word = rest[k]
                    parts[k] = memo[word] if word in memo else self._keep(memo, word, self._word(word))
        if False in parts:  # a word next to other white space
            return self.whole(text)
        return (self.whole(first) if first else b"") + b"".join(parts)


@cache
def encoder(path: str) -> Encoder:
    """One encoder for each tokenizer file and worker."""
    return Encoder(path)
