"""An Elias-Fano n-gram trie in memory-mapped levels, one shard of contexts to a file.

Level 1 holds the first words of the shard, level 2 the words that follow each of them, level 3 the words that follow each pair. A word's place in a level is stored
relative to its context: rank of the context x size of the vocabulary + word, so a whole level is one rising sequence, kept as Elias-Fano: low bits packed, high
bits in unary, with a count of ones for every 64 bits. Pointers from a context to its successors are such sequences, too. A lookup finds the context, takes from the pointers where
its successors begin and end, and searches the first one that is not smaller among those with the same high bits; nothing is expanded. Joint
probabilities of pairs and triples are quantised on a logarithmic grid of 16 bits, which begins at the probability of what occurs once.
"""

from __future__ import annotations

import os
import tempfile
from functools import lru_cache

import numpy as np

BITS = 16  # of a quantised probability; code 0: none
NEAR = 2  # elements that are looked at one after another before a search by halves
U = np.uint64


def least(n: int) -> float:
    """log10 of the least probability on the grid: that of what occurs once among n, so no count is raised to a floor."""
    return -float(np.log10(max(n, 10)))


def quantise(p: np.ndarray, low: float) -> np.ndarray:
    """Codes of probabilities on the grid from 10**low to 1."""
    step = -low / ((1 << BITS) - 2)
    return np.clip(np.rint((np.log10(np.maximum(p, 1e-300)) - low) / step) + 1, 1, (1 << BITS) - 1).astype(np.uint16)


@lru_cache(maxsize=4)
def _grid(low: float) -> np.ndarray:
    return np.concatenate([[0.0], 10.0 ** (np.arange((1 << BITS) - 1) * (-low / ((1 << BITS) - 2)) + low)])


def restore(code: np.ndarray, low: float) -> np.ndarray:
    """Probability of a code; 0 for none."""
    return _grid(low)[code.astype(np.int64)]


def _put(values: np.ndarray, at: np.ndarray, width: int, total: int) -> np.ndarray:
    """Values of so many bits at rising bit places that do not overlap, in 64-bit words, the first bit the lowest, with a word to spare."""
    out = np.zeros((total >> 6) + 2, U)
    if width and len(values):
        word, shift = at >> 6, (at & 63).astype(U)
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[heads]] = np.bitwise_or.reduceat(values << shift, heads)
        over = np.flatnonzero(shift + U(width) > U(64))  # at most one for a word
        out[word[over] + 1] |= values[over] >> (U(64) - shift[over])
    return out


def elias_fano(x: np.ndarray) -> dict[str, np.ndarray]:
    """A rising sequence of unsigned integers: header (length, low bits), packed low bits, unary high bits, and ones before each word of those."""
    n, top = len(x), int(x[-1]) + 1 if len(x) else 1
    low = max(0, (top // max(n, 1)).bit_length() - 1)
    place = np.arange(n, dtype=np.int64)
    high = (x >> U(low)).astype(np.int64)
    width = n + (int(high[-1]) if n else 0) + 1
    words = _put(np.ones(n, U), high + place, 1, width)
    return {"head": np.array([n, low, width], np.int64), "low": _put(x & U((1 << low) - 1), place * low, low, n * low), "high": words, "ones": np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])}


class EliasFano:
    """Reads a sequence from mapped arrays."""

    def __init__(self, head: np.ndarray, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.bits, self.width = (int(v) for v in head)
        self.low, self.high, self.ones = low, high, ones
        self.zeros = 64 * np.arange(len(ones), dtype=np.int64) - ones

    def _select(self, r: np.ndarray, before: np.ndarray, flip: bool) -> np.ndarray:
        """Place of the r-th (from 0) set bit, or of the r-th unset one."""
        at = np.searchsorted(before, r, "right") - 1
        word, left = self.high[at], (r - before[at]).astype(np.uint8)
        word = ~word if flip else word
        place = np.zeros(len(at), np.uint8)
        for step in (32, 16, 8, 4, 2, 1):
            inside = np.bitwise_count(word & U((1 << step) - 1))
            on = (left >= inside).astype(np.uint8)
            left -= inside * on
            on *= np.uint8(step)
            word >>= on.astype(U)
            place += on
        return at * 64 + place

    def lows(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), U)
        at = i.astype(np.int64) * self.bits
        word, shift = at >> 6, (at & 63).astype(U)
        value = self.low[word] >> shift
        over = self.low[word + 1] << (U(63) - shift) << U(1)
        return (value | over) & U((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        i = i.astype(np.int64)
        return (self._select(i, self.ones, False) - i).astype(U) << U(self.bits) | self.lows(i)

    def _begin(self, high: np.ndarray) -> np.ndarray:
        """Elements whose high part is smaller."""
        most = self.width - self.n  # zeros in the unary part
        h = np.minimum(high, most)
        out = np.zeros(len(h), np.int64)
        some = h > 0
        out[some] = self._select(h[some] - 1, self.zeros, True) - (h[some] - 1)
        return np.where(high > most, self.n, out)

    def successor(self, x: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of the first element of start to stop that is not smaller, stop (or the length) if there is none."""
        high, low = (x >> U(self.bits)).astype(np.int64), x & U((1 << self.bits) - 1)
        lo, hi = self._begin(high), self._begin(high + 1)
        if start is not None:
            lo, hi = np.clip(lo, start, stop), np.clip(hi, start, stop)
        while True:
            open_ = np.flatnonzero(lo < hi)
            if not len(open_):
                return lo
            mid = (lo[open_] + hi[open_]) // 2
            less = self.lows(mid) < low[open_]
            lo[open_] = np.where(less, mid + 1, lo[open_])
            hi[open_] = np.where(less, hi[open_], mid)

    def find(self, x: np.ndarray, start: np.ndarray | None = None, stop: np.ndarray | None = None) -> np.ndarray:
        """Index of the element, -1 if it is not there, or not from start to stop. Elements are distinct.

        Those with the high part of x are ones in a row after the zeros of smaller ones; the search goes on along them to the first whose low part is not smaller.
        """
        out = np.full(len(x), -1)
        if not self.n:
            return out
        high, low = (x >> U(self.bits)).astype(np.int64), x & U((1 << self.bits) - 1)
        i, open_ = self._begin(high), np.flatnonzero(high <= self.width - self.n)
        i, low, at = i[open_], low[open_], high[open_]
        for _ in range(NEAR):
            if not len(open_):
                break
            place = at + i
            there = np.flatnonzero((self.high[place >> 6] >> (place & 63).astype(U)) & U(1))
            open_, i, low, at = open_[there], i[there], low[there], at[there]
            value = self.lows(i)
            same = np.flatnonzero(value == low)
            out[open_[same]] = i[same]
            on = np.flatnonzero(value < low)
            open_, i, low, at = open_[on], i[on] + 1, low[on], at[on]
        if len(open_):
            # many words of one context share their high part: by halves
            hi = self._begin(at + 1)
            end = hi.copy()
            left = np.arange(len(open_))
            while len(left := left[i[left] < hi[left]]):
                mid = (i[left] + hi[left]) // 2
                less = self.lows(mid) < low[left]
                i[left] = np.where(less, mid + 1, i[left])
                hi[left] = np.where(less, hi[left], mid)
            there = np.flatnonzero(i < end)
            there = there[self.lows(i[there]) == low[there]]
            out[open_[there]] = i[there]
        return out if start is None else np.where((out >= start) & (out < stop), out, -1)


def _new(x: np.ndarray) -> np.ndarray:
    """Which elements differ from the one before."""
    new = np.ones(len(x), bool)
    new[1:] = x[1:] != x[:-1]
    return new


def _union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = np.sort(np.concatenate([a, b]))
    return x[_new(x)]


def _ranks(some: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of x, whose equal elements come in a row, among some."""
    heads = np.flatnonzero(_new(x))
    return np.repeat(np.searchsorted(some, x[heads]).astype(U), np.diff(np.append(heads, len(x))))


class Trie:
    """pairs and triples: arrays of first, second (and third) words, distinct and in order, with their probabilities. Levels hold what either of them needs."""

    def __init__(self, pairs: tuple, triples: tuple, low: float):
        (u, v, p2), (a, b, c, p3) = pairs, triples
        self.size = 1 + max((int(x.max()) for x in (u, v, a, b, c) if len(x)), default=0)
        size = U(self.size)
        first = _union(u[_new(u)], a[_new(a)])
        own = _ranks(first, u) * size + v
        heads = np.flatnonzero(_new(a) | _new(b))
        path = _ranks(first, a[heads]) * size + b[heads]
        second = _union(own, path)
        q2 = np.zeros(len(second), np.uint16)
        q2[np.searchsorted(second, own)] = quantise(p2, low)
        third = np.repeat(np.searchsorted(second, path).astype(U), np.diff(np.append(heads, len(a)))) * size + c
        edges = lambda level, n: np.searchsorted(level, np.arange(n + 1, dtype=U) * size).astype(U)
        seqs = {"1": first, "p": edges(second, len(first)), "2": second, "r": edges(third, len(second)), "3": third}
        parts = {f"{s}.{k}": x for s, seq in seqs.items() for k, x in elias_fano(seq).items()} | {"q2": q2, "q3": quantise(p3, low)}
        self.file, at, spans = tempfile.NamedTemporaryFile(prefix="trie-"), 0, {}
        for k, x in parts.items():
            self.file.write(x.tobytes())
            spans[k] = (at, x.dtype, x.size)
            pad = -x.nbytes % 8
            self.file.write(b"\0" * pad)
            at += x.nbytes + pad
        self.file.flush()
        level = {k: np.memmap(self.file.name, t, "r", o, (n,)) if n else np.zeros(0, t) for k, (o, t, n) in spans.items()}
        self.bytes = os.path.getsize(self.file.name)
        self.first, self.to_second, self.second, self.to_third, self.third = (EliasFano(*(level[f"{s}.{k}"] for k in ("head", "low", "high", "ones"))) for s in "1p2r3")
        self.q2, self.q3 = level["q2"], level["q3"]

    def _child(self, level: EliasFano, pointers: EliasFano, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Index in a level of a word after its context, -1 if there is none."""
        out = np.full(len(parent), -1)
        ok = np.flatnonzero((parent >= 0) & (word < self.size))
        if len(ok):
            # the words of one context come one after another; the next context begins where one ends
            new = _new(parent[ok])
            some = parent[ok][new]
            both = _union(some, some + 1)
            edge = pointers.get(both).astype(np.int64)
            start, stop = (edge[np.searchsorted(both, some + k)][np.cumsum(new) - 1] for k in (0, 1))
            out[ok] = level.find(parent[ok].astype(U) * U(self.size) + word[ok], start, stop)
        return out

    def _pair(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        new = _new(u)
        return self._child(self.second, self.to_second, self.first.find(u[new])[np.cumsum(new) - 1], v)

    def pairs(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """Codes of the probabilities of pairs; 0: not seen."""
        i = self._pair(u, v)
        return np.where(i >= 0, self.q2[np.maximum(i, 0)] if len(self.q2) else 0, 0).astype(np.uint16)

    def triples(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Codes of the probabilities of triples; 0: not seen."""
        new = _new(u) | _new(v)  # triples of one pair come one after another
        heads = np.flatnonzero(new)
        i = self._child(self.third, self.to_third, self._pair(u[heads], v[heads])[np.cumsum(new) - 1], w)
        return np.where(i >= 0, self.q3[np.maximum(i, 0)] if len(self.q3) else 0, 0).astype(np.uint16)

    def close(self) -> None:
        self.file.close()
