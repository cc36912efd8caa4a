"""Suffix arrays by induced sorting with queues that spill to disk.

A suffix is of type S if it is smaller than the one after it, else L; one of type S after one of
type L is a seed. The seeds are put in order by naming the stretches from seed to seed and, where
names repeat, by sorting the string of names the same way. All others follow by induction: who
reads the sorted suffixes upwards finds the suffix before each, if of type L, in its final order
within the bucket of its first symbol; reading downwards does the same for type S. What was found
waits in a priority queue by first symbol. Suffixes arrive there in order, so the queue is one
line per symbol, and the lines go to disk when they hold more than their share of memory.

Each tuple in a queue carries the place of its suffix and what it has in common with the one
before it in line: one symbol more than the least that the reader saw in common since then.
"""

from __future__ import annotations

import tempfile
from collections import defaultdict

import numpy as np

#: Tuples that the queues of one sort hold in memory.
QUEUED = 4_000_000


class Lines:
    """First-in, first-out lines of (place, common) tuples by symbol, on disk beyond ``QUEUED`` tuples."""

    def __init__(self) -> None:
        self.held: dict[int, list[np.ndarray]] = defaultdict(list)
        self.stored: dict[int, list[tuple[int, int]]] = defaultdict(list)
        self.count, self.file = 0, None

    def push(self, symbol: int, tuples: np.ndarray) -> None:
        self.held[symbol].append(tuples)
        self.count += len(tuples)
        if self.count > QUEUED:
            self.spill()

    def spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()  # this task's own, gone when it ends
        for symbol, parts in self.held.items():
            if parts:
                at = self.file.seek(0, 2)
                whole = np.concatenate(parts)
                self.file.write(whole.tobytes())
                self.stored[symbol].append((at, len(whole)))
                parts.clear()
        self.count = 0

    def pop(self, symbol: int) -> np.ndarray:
        """Takes what stands in the line now."""
        parts = []
        for at, n in self.stored.pop(symbol, ()):
            self.file.seek(at)
            parts.append(np.frombuffer(self.file.read(n * 16), np.int64).reshape(-1, 2))
        held = self.held.pop(symbol, [])
        self.count -= sum(map(len, held))
        parts += held
        return np.concatenate(parts) if parts else np.empty((0, 2), np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


def large_types(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is of type L. The last symbol is the only smallest one; its suffix is of type S."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    follows = np.searchsorted(differs, np.arange(n - 1))
    at = differs[follows]
    return np.append(t[at] > t[at + 1], False)


def names_of(t: np.ndarray, is_large: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Rank of the stretch that starts at each seed, equal stretches sharing one."""
    symbols = t.astype(np.int64) * 2 + ~is_large + 1
    bits = int(symbols.max()).bit_length()
    step = max(1, 62 // bits)
    shifts = bits * np.arange(step - 1, -1, -1)
    ends = np.append(seeds[1:] + 1, len(t))
    names = np.zeros(len(seeds), np.int64)
    at, open_ = seeds.copy(), np.arange(len(seeds))
    while len(open_):
        # Ties so far are told apart by their next symbols; a stretch that has ended is filled up with zeros.
        key = np.zeros(len(open_), np.int64)
        for k, shift in enumerate(shifts.tolist()):
            place = at[open_] + k
            key |= np.where(place < ends[open_], symbols[np.minimum(place, len(t) - 1)], 0) << shift
        own, rank = np.unique(key, return_inverse=True)
        base = names[open_]
        own, rank = np.unique(base * len(own) + rank, return_inverse=True)
        # A name leaves room for as many more as it has seeds, so that refined names stay in order.
        counts = np.bincount(rank, minlength=len(own))
        first = np.zeros(len(own), np.int64)
        first[rank] = base
        before = np.cumsum(counts) - counts
        starts = np.searchsorted(first, first)  # first own name with the same base
        names[open_] = (first + before - before[starts])[rank]
        at[open_] += step
        open_ = open_[(at[open_] < ends[open_]) & (counts[rank] > 1)]
    return names


def seed_order(t: np.ndarray, is_large: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """The seeds in the order of their suffixes."""
    names = names_of(t, is_large, seeds)
    order = np.argsort(names, kind="stable")
    if (names[order][1:] == names[order][:-1]).any():
        order = sorted_names(np.unique(names, return_inverse=True)[1])
    return seeds[order]


def sorted_names(t: np.ndarray) -> np.ndarray:
    """Order of the suffixes of a string of names, which are 0, 1, ... and whose last one is the only smallest.

    Induced like the text itself, with a line for every name; what they share is not asked here.
    """
    if len(t) < 3:
        return np.argsort(t)
    is_large = large_types(t)
    seeds = np.flatnonzero(~is_large[1:] & is_large[:-1]) + 1
    ordered = seed_order(t, is_large, seeds) if len(seeds) > 1 else seeds
    top = int(t.max()) + 1
    begins = np.searchsorted(t[ordered], np.arange(top + 1)).tolist()
    text, wanted, ordered = t.tolist(), is_large.tolist(), ordered.tolist()
    large: list[list[int] | None] = [None] * top
    for c in range(top):
        line = large[c]
        if line:
            for s in line:  # the line may grow as it is read
                if wanted[s - 1]:
                    q = text[s - 1]
                    if large[q] is None:
                        large[q] = [s - 1]
                    else:
                        large[q].append(s - 1)
        for s in ordered[begins[c] : begins[c + 1]]:
            if wanted[s - 1]:
                q = text[s - 1]
                if large[q] is None:
                    large[q] = [s - 1]
                else:
                    large[q].append(s - 1)
    # The last suffix, smallest of all, has none after it that would lead to it, and it is the one before the first.
    wanted = (~is_large).tolist()
    wanted[-1] = False
    small: list[list[int] | None] = [None] * top
    for c in range(top - 1, -1, -1):
        for line in (small[c], large[c][::-1] if large[c] else None):
            for s in line or ():
                if wanted[s - 1]:
                    q = text[s - 1]
                    if small[q] is None:
                        small[q] = [s - 1]
                    else:
                        small[q].append(s - 1)
    out = [len(t) - 1]
    for c in range(top):
        out += large[c] or ()
        out += (small[c] or ())[::-1]
    return np.array(out, np.int64)


def common(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that the suffixes at ``a`` and ``b`` share, ``cap`` at most."""
    out = np.zeros(len(a), np.int64)
    open_ = np.arange(len(a))
    step = 4  # symbols of 16 bits make a word
    if len(a) > 64 and len(t) > step and t.max() < 1 << 16:
        words = np.lib.stride_tricks.as_strided(t.astype(np.uint16).view(np.uint8), (len(t) - step + 1, 8), (2, 1))
        words = np.ascontiguousarray(words).view(np.uint64).ravel()
        for d in range(0, cap - step + 1, step):
            x, y = a[open_] + d, b[open_] + d
            inside = (x < len(words)) & (y < len(words))
            open_ = open_[inside & (words[np.minimum(x, len(words) - 1)] == words[np.minimum(y, len(words) - 1)])]
            if not len(open_):
                break
            out[open_] = d + step
        cap, open_ = np.minimum(cap - out, step), np.arange(len(a))
    last = len(t) - 1
    base = out.copy()
    for d in range(int(np.max(cap, initial=0))):
        x, y = a[open_] + base[open_] + d, b[open_] + base[open_] + d
        more = (x <= last) & (y <= last) & (t[np.minimum(x, last)] == t[np.minimum(y, last)])
        if np.ndim(cap):
            more &= d < cap[open_]
        open_ = open_[more]
        if not len(open_):
            break
        out[open_] = base[open_] + d + 1
    return out


class Reader:
    """Reads tuples in order and puts those found before them into lines."""

    def __init__(self, t: np.ndarray, wanted: np.ndarray, cap: int) -> None:
        self.t, self.wanted, self.cap = t, wanted, cap
        self.lines = Lines()
        # The least in common since the last tuple that went into each line.
        self.least = np.full(int(t.max()) + 1, cap, np.int64)

    def read(self, places: np.ndarray, shared: np.ndarray) -> None:
        before = places - 1
        k = np.flatnonzero((before >= 0) & self.wanted[before])
        symbols = self.t[before[k]]
        order = np.argsort(symbols.astype(np.uint16) if len(self.least) < 1 << 16 else symbols, kind="stable")
        whole = shared.min() if len(shared) else self.cap
        least = np.minimum(self.least, whole)
        edges = np.flatnonzero(np.diff(symbols[order])) + 1
        for some in np.split(order, edges) if len(order) else ():
            symbol, at = int(symbols[some[0]]), k[some]
            pieces = np.minimum.reduceat(shared, np.concatenate([[0], at[:-1] + 1]))
            # reduceat takes each stretch up to the next start; the last one must end with the last tuple found.
            pieces[-1] = shared[(at[-2] + 1 if len(at) > 1 else 0) : at[-1] + 1].min()
            pieces[0] = min(pieces[0], self.least[symbol])
            least[symbol] = shared[at[-1] + 1 :].min(initial=self.cap)
            self.lines.push(symbol, np.stack([before[at], np.minimum(pieces + 1, self.cap)], 1))
        self.least = least


def suffix_array(t: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of ``t`` and what each shares with the one before it, ``cap`` symbols at most.

    ``t`` is an array of non-negative integers whose last one is the only smallest.
    """
    n = len(t)
    if n < 3:
        sa = np.argsort(t, kind="stable")
        return sa, np.zeros(n, np.int64)
    is_large = large_types(t)
    seeds = np.flatnonzero(~is_large[1:] & is_large[:-1]) + 1
    ordered = seed_order(t, is_large, seeds) if len(seeds) > 1 else seeds
    in_common = np.concatenate([[0], common(t, ordered[:-1], ordered[1:], cap)])
    first = t[ordered]
    top = int(t.max()) + 1
    begins = np.searchsorted(first, np.arange(top + 1))

    def tied(a: int, b: int) -> int:
        return int(common(t, np.array([a]), np.array([b]), cap)[0])

    up = Reader(t, is_large, cap)
    large: list[np.ndarray] = []
    for c in range(top):
        parts = []
        while len(line := up.lines.pop(c)):
            if not parts:
                line = line.copy()
                line[0, 1] = 0
            parts.append(line)
            up.read(line[:, 0], line[:, 1])
        large.append(np.concatenate(parts) if parts else np.empty((0, 2), np.int64))
        some, shared = ordered[begins[c] : begins[c + 1]], in_common[begins[c] : begins[c + 1]].copy()
        if len(some):
            shared[0] = tied(large[c][-1, 0], some[0]) if len(large[c]) else 0
            up.read(some, shared)
    up.lines.close()

    down = Reader(t, ~is_large, cap)
    places: list[np.ndarray] = []
    shares: list[np.ndarray] = []
    for c in reversed(range(top)):
        parts = []
        while len(line := down.lines.pop(c)):
            if not parts:
                line = line.copy()
                line[0, 1] = 0
            parts.append(line)
            down.read(line[:, 0], line[:, 1])
        if c == t[-1]:
            parts = [np.array([[n - 1, 0]], np.int64)]
            down.read(parts[0][:, 0], parts[0][:, 1])
        small = np.concatenate(parts) if parts else np.empty((0, 2), np.int64)
        if len(large[c]):
            line = large[c][::-1]
            shared = np.concatenate([[tied(small[-1, 0], line[0, 0]) if len(small) else 0], line[:-1, 1]])
            down.read(line[:, 0], shared)
        whole = np.concatenate([large[c][:, 0], small[::-1, 0]])
        between = [tied(large[c][-1, 0], small[-1, 0])] if len(large[c]) and len(small) else [0] * bool(len(small))
        # Read downwards, a tuple's share is with the one above it.
        with_next = small[::-1, 1][:-1] if len(small) else np.empty(0, np.int64)
        places.append(whole)
        shares.append(np.concatenate([large[c][:, 1], between, with_next]).astype(np.int64))
        large[c] = None
    down.lines.close()
    return np.concatenate(places[::-1]), np.concatenate(shares[::-1])
