"""Personal data replaced by format-preserving pseudonyms.

Numbers that pass their own check (card, bank account, social security, phone, network address),
dates that exist, mail addresses and secrets are ranked within all values of their format, the rank
goes through a keyed Feistel permutation, and the result is written in the same format: a card
number still passes its check, a date is still one. The permutation depends on key and kind alone,
so equal values get equal pseudonyms in every document and task, different ones different ones, and
the key's holder can undo it. Each document is handled alone, without a shuffle.
"""

from __future__ import annotations

import calendar
import hashlib
import math
import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.frames import arrow_schema, batches, narrowed, pairs, type_of

ROUNDS = 10
FIRST_YEAR, YEARS = 1900, 200
KINDS = ("email", "secret", "iban", "card", "ssn", "phone", "ip", "date")
#: Characters of a bank account by country, after the register of the standard and its trial users.
IBAN_LENGTHS = {
    country: int(n)
    for n, countries in (
        line.split(":")
        for line in (
            "15:NO", "16:BE", "18:DK FI FO GL NL SD FK", "19:MK SI", "20:AT BA EE KZ LT LU MN XK", "21:CH HR LI LV",
            "22:BG BH CR DE GB GE IE ME RS VA", "23:AE GI IL IQ OM SO TL", "24:AD CZ ES MD PK RO SA SE SK TN VG",
            "25:AO CV GW LY MZ PT ST", "26:DZ IR IS TR", "27:BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD",
            "28:AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
            "29:BR EG PS QA UA", "30:JO KW MU YE", "31:MT SC", "32:LC", "33:RU",
        )
    )
    for country in countries.split()
}
ALPHABETS = (string.ascii_lowercase, string.ascii_uppercase, string.digits)


class Feistel:
    """Keyed permutation of 0 .. n-1."""

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.n, self.left = n, math.isqrt(n - 1) + 1
        self.right = -(-n // self.left)
        self.key, self.tweak = hashlib.sha256(key).digest(), tweak.encode()

    def _noise(self, k: int, x: int) -> int:
        raw = b"%d|%s|%d|%x" % (k, self.tweak, self.n, x)
        return int.from_bytes(hashlib.blake2b(raw, key=self.key).digest(), "big")

    def _once(self, x: int, back: bool) -> int:
        a, b = divmod(x, self.right)
        for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
            sign = -1 if back else 1
            if k % 2:
                b = (b + sign * self._noise(k, a)) % self.right
            else:
                a = (a + sign * self._noise(k, b)) % self.left
        return a * self.right + b

    def __call__(self, x: int, valid: Callable[[int], bool] = lambda _: True, back: bool = False) -> int:
        """Walks on until the value is in the domain and valid, which permutes the valid values."""
        while True:
            x = self._once(x, back)
            if x < self.n and valid(x):
                return x


def rank(digits: list[int], radices: list[int]) -> int:
    x = 0
    for d, r in zip(digits, radices):
        x = x * r + d
    return x


def unrank(x: int, radices: list[int]) -> list[int]:
    digits = []
    for r in reversed(radices):
        x, d = divmod(x, r)
        digits.append(d)
    return digits[::-1]


def luhn(digits: str) -> int:
    """Check digit that follows these digits."""
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 - k % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def iban_rest(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97


def iban_ends(text: str) -> list[int]:
    """Ends that a bank account starting ``text`` may have: a group end at its country's length, or the whole."""
    ends = [k for k in range(1, len(text)) if text[k] == " "]
    return [k for k in ends if k - text[:k].count(" ") == IBAN_LENGTHS.get(text[:2])] + [len(text)]


def filled(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced in order."""
    own = iter(digits)
    return "".join(next(own) if c.isdigit() else c for c in shape)


def plain_digits(text: str) -> str:
    return re.sub(r"\D", "", text)


class Pseudonyms:
    """Values of each kind to pseudonyms; ``back`` restores the values."""

    def __init__(self, key: bytes, back: bool = False) -> None:
        self.key, self.back = key, back

    def permuted(self, tweak: str, digits: list[int], radices: list[int], valid: Callable[[list[int]], bool] | None = None) -> list[int]:
        n = math.prod(radices)
        if n < 2:
            return digits
        walk = Feistel(self.key, tweak, n)
        return unrank(walk(rank(digits, radices), (lambda x: valid(unrank(x, radices))) if valid else lambda _: True, self.back), radices)

    def spelled(self, kind: str, text: str) -> str:
        """Letters and digits permuted within their class, all else kept."""
        own = [next((a for a in ALPHABETS if c in a), "") for c in text]
        radices = [len(a) for a in own if a]
        tweak = kind + "".join("aA0"[ALPHABETS.index(a)] if a else c for a, c in zip(own, text))
        got = iter(self.permuted(tweak, [a.index(c) for a, c in zip(own, text) if a], radices))
        return "".join(a[next(got)] if a else c for a, c in zip(own, text))

    def numbers(self, kind: str, digits: str, radices: list[int], low: list[int]) -> str:
        got = self.permuted(kind + str(len(digits)), [int(c) - b for c, b in zip(digits, low)], radices)
        return "".join(str(d + b) for d, b in zip(got, low))

    def email(self, text: str) -> str | None:
        local, _, domain = text.partition("@")
        return f"{self.spelled('email', local)}@{domain}"

    def secret(self, text: str) -> str | None:
        if re.fullmatch(r"AKIA[0-9A-Z]+", text):
            return "AKIA" + self.based("secret", text[4:], string.ascii_uppercase + string.digits)
        if re.fullmatch(r"[0-9a-f]+", text):
            return self.based("secret", text, "0123456789abcdef")
        return self.spelled("secret", text)

    def based(self, kind: str, text: str, alphabet: str) -> str:
        got = self.permuted(f"{kind}{len(alphabet)}", [alphabet.index(c) for c in text], [len(alphabet)] * len(text))
        return "".join(alphabet[d] for d in got)

    def iban(self, text: str) -> str | None:
        bare = text.replace(" ", "")
        if not 15 <= len(bare) <= 34 or iban_rest(bare) != 1:
            return None
        body = self.spelled("iban" + bare[:2], bare[4:])
        check = f"{98 - iban_rest(bare[:2] + '00' + body):02d}"
        own = iter(bare[:2] + check + body)
        return "".join(" " if c == " " else next(own) for c in text)

    def card(self, text: str) -> str | None:
        digits = plain_digits(text)
        if not 13 <= len(digits) <= 19 or digits[0] == "0" or luhn(digits[:-1]) != int(digits[-1]):
            return None
        middle = len(digits) - 2
        body = digits[0] + self.numbers("card" + digits[0], digits[1:-1], [10] * middle, [0] * middle)
        return filled(text, body + str(luhn(body)))

    def ssn(self, text: str) -> str | None:
        area, group, serial = map(int, text.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return None
        a, g, s = self.permuted("ssn", [area - 1, group - 1, serial - 1], [899, 99, 9999], lambda d: d[0] != 665)
        return f"{a + 1:03d}-{g + 1:02d}-{s + 1:04d}"

    def phone(self, text: str) -> str | None:
        digits = plain_digits(text)
        own = digits[-10:]
        if len(digits) == 10 or len(digits) == 11 and digits[0] == "1":
            if own[0] in "01" or own[3] in "01":
                return None
            radices, low = [8, 10, 10, 8] + [10] * 6, [2, 0, 0, 2] + [0] * 6
            return filled(text, digits[:-10] + self.numbers("phone", own, radices, low))
        if not text.startswith("+") or not 8 <= len(digits) <= 15:
            return None
        rest = len(digits) - 3
        return filled(text, digits[:3] + self.numbers("phone" + digits[:3], digits[3:], [10] * rest, [0] * rest))

    def ip(self, text: str) -> str | None:
        parts = text.split(".")
        if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
            return None
        return ".".join(map(str, self.permuted("ip", [int(p) for p in parts], [256] * 4)))

    def date(self, text: str) -> str | None:
        """Year first, or month and day before the year; day before month where it cannot be a month."""
        mark = next(c for c in text if not c.isdigit())
        parts = [int(p) for p in text.split(mark)]
        first = len(text.split(mark)[0]) == 4
        swapped = not first and parts[0] > 12
        y, m, d = parts if first else (parts[2], parts[1], parts[0]) if swapped else (parts[2], parts[0], parts[1])
        if not (FIRST_YEAR <= y < FIRST_YEAR + YEARS and 1 <= m <= 12 and 1 <= d <= calendar.monthrange(y, m)[1]):
            return None

        def real(x: list[int]) -> bool:
            return x[2] < calendar.monthrange(x[0] + FIRST_YEAR, x[1] + 1)[1] and (x[2] >= 12 or not swapped)

        got = self.permuted("swapped" if swapped else "date", [y - FIRST_YEAR, m - 1, d - 1], [YEARS, 12, 31], real)
        y, m, d = got[0] + FIRST_YEAR, got[1] + 1, got[2] + 1
        own = (y, m, d) if first else (d, m, y) if swapped else (m, d, y)
        widths = [len(p) if len(p) == 4 else 2 for p in text.split(mark)]
        return mark.join(f"{x:0{w}d}" for x, w in zip(own, widths))


#: What may be a value of each kind; the value is group 1. Whether it is one, its check decides.
PATTERNS = {
    "email": r"(?<![\w.+%-])([A-Za-z0-9](?:[\w.+%-]{0,62}[A-Za-z0-9_])?@(?:[A-Za-z0-9-]{1,63}\.)+[A-Za-z]{2,24})(?![\w-])",
    "secret": r"(?<![A-Za-z0-9])(AKIA[0-9A-Z]{16})(?![A-Za-z0-9])"
    r"|(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?"
    r"((?=[A-Za-z_+/-]{0,99}[0-9])[A-Za-z0-9_+/-]{8,100})(?![A-Za-z0-9_+/-])",
    "iban": r"(?<![A-Za-z0-9])([A-Z]{2}\d{2}(?: ?[A-Z0-9]){11,30})(?![A-Za-z0-9])",
    "card": r"(?<![\w-])(?<!\d\.)(\d{13,19}|\d{4}(?:[ -]\d{4}){2}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])(?!\.\d)",
    "ssn": r"(?<![\d-])(\d{3}-\d{2}-\d{4})(?![\d-])",
    "phone": r"(?<![\w+-])(?<!\d\.)((?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5})(?![\w-])(?!\.\d)",
    "ip": r"(?<![\w.])(\d{1,3}(?:\.\d{1,3}){3})(?![\w])(?!\.\d)",
    "date": r"(?<![\w./-])((?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2})(?=[Tt](?:[01]\d|2[0-4]))"
    r"|(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}\.\d{1,2}\.\d{4})(?![\w/-])(?!\.\d))",
}
MEMO = 1 << 14


class Redactor:
    def __init__(self, key: bytes, kinds: tuple[str, ...] = KINDS, back: bool = False) -> None:
        self.kinds = [(k, re.compile(PATTERNS[k])) for k in kinds]
        own = Pseudonyms(key, back)
        self.pseudonym = lru_cache(MEMO)(lambda kind, value: getattr(own, kind)(value))

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of every value; kinds named first go first where two overlap."""
        found: list[tuple[int, int, str, str]] = []
        # Without these a text holds no value of the kind, which spares most texts the patterns.
        digits = any(c in text for c in string.digits)
        may_hold = {"email": "@" in text, "secret": digits or "AKIA" in text}
        for kind, pattern in self.kinds:
            if not may_hold.get(kind, digits):
                continue
            taken = sorted(found)
            starts = [t[0] for t in taken]
            values = self.accounts(text, pattern) if kind == "iban" else self.values(text, kind, pattern)
            for start, end, pseudonym in values:
                before = bisect_left(starts, end)  # values do not overlap, so only the last one that starts before the end can
                if not before or taken[before - 1][1] <= start:
                    found.append((start, end, kind, pseudonym))
        return sorted(found)

    def values(self, text: str, kind: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str]]:
        for match in pattern.finditer(text):
            pseudonym = self.pseudonym(kind, match[match.lastindex])
            if pseudonym is not None:
                yield (*match.span(match.lastindex), pseudonym)

    def accounts(self, text: str, pattern: re.Pattern) -> Iterator[tuple[int, int, str]]:
        """Bank accounts; what follows one in groups of its own is no part of it, and one may follow what is none."""
        match = pattern.search(text)
        while match:
            start, value = match.start(1), match[1]
            tried = ((end, self.pseudonym("iban", value[:end])) for end in iban_ends(value))
            end, pseudonym = next(((e, p) for e, p in tried if p is not None), (1, None))
            if pseudonym is not None:
                yield start, start + end, pseudonym
            match = pattern.search(text, start + end)

    def replaced(self, text: str | None) -> tuple[str | None, Counter]:
        if not text:
            return text, Counter()
        spans = self.spans(text)
        parts, at = [], 0
        for start, end, _, pseudonym in spans:
            parts += [text[at:start], pseudonym]
            at = end
        return "".join(parts) + text[at:], Counter(kind for _, _, kind, _ in spans)


def pseudonymized(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """One row per document: doc_id, a count for each kind (``n_email`` and so on), and the new ``text``.

    A missing text stays missing, an empty one empty; repeated rows and missing ids give a row
    each; other columns are ignored.
    """
    rows = narrowed(docs, id_col, text_col)
    result = f"doc_id {type_of(rows, 'doc_id')}, " + ", ".join(f"n_{k} long" for k in kinds) + ", text string"
    schema = arrow_schema(result)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = Redactor(key, kinds)

        def out() -> Iterator[tuple]:
            for doc_id, text in pairs(source):
                new, counts = redactor.replaced(text)
                yield (doc_id, *(counts[k] for k in kinds), new)

        yield from batches(out(), schema)

    return rows.mapInArrow(run, result)


def without_personal_data(docs: DataFrame, key: bytes, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """``docs`` with all columns and the values in ``text_col`` replaced; missing and empty texts stay, every row stays."""
    place = docs.columns.index(text_col)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        redactor = Redactor(key, kinds)
        for b in source:
            field = b.schema.field(place)
            yield b.set_column(place, field, pa.array([redactor.replaced(x.as_py())[0] for x in b.column(place)], field.type))

    return docs.mapInArrow(run, docs.schema)
