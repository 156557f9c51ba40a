"""Column-wise construction of the Burrows-Wheeler transform and common prefixes of a collection of strings.

All strings are read from the right, one symbol of each in every round. A round inserts, for each string, the suffix that is one symbol longer:
its place follows from the symbol's rank in the transform so far, and its common prefixes with its two neighbours are one more than the least common prefix between
the places where the symbol occurred before and occurs next. Transform and prefixes are read from one file and written to the next, both from front to end, in the task's temporary
folder; a task that is lost writes its files anew. Common prefixes are capped, as only whether they reach a length matters.
"""

from __future__ import annotations

import tempfile

import numpy as np

STEP = 4 << 20  # pairs that are read or written at once


class _File:
    """A sequential file of pairs of a symbol and a common prefix that is written once and read once."""

    def __init__(self, x: np.ndarray):
        self.f = tempfile.TemporaryFile(buffering=0)
        for at in range(0, x.size, STEP):
            self.f.write(x[at : at + STEP].data)
        self.n = x.size

    def read(self) -> np.ndarray:
        x = np.empty(self.n, np.uint16)
        self.f.seek(0)
        for at in range(0, self.n, STEP):
            self.f.readinto(x[at : at + STEP].data)
        self.f.close()
        return x


def build(strings: np.ndarray, lengths: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The transform (0 where a string begins, else byte + 1) and the capped common prefix of every suffix with the one before, in order of suffixes.

    strings: bytes below 255, one string to a row, at the right end of the row. Empty suffixes come first, in order of strings.
    """
    m, width = strings.shape
    symbols = strings + np.uint8(1)

    def symbol(who: np.ndarray, done: int) -> np.ndarray:
        """What precedes the suffix of so many symbols."""
        left = width - 1 - done
        s = symbols[who, left] if left >= 0 else np.zeros(len(who), np.uint8)
        return np.where(lengths[who] > done, s, np.uint8(0))

    who, place = np.arange(m), np.arange(m)
    file = _File(_pairs(symbol(who, 0), np.zeros(m, np.uint8)))
    for done in range(1, int(lengths.max(initial=0)) + 1):
        pairs = file.read()
        bwt, lcp = pairs.astype(np.uint8), (pairs >> 8).astype(np.uint8)
        c = bwt[place]
        alive = np.flatnonzero(c)
        # places rise, so these are in order of their new suffixes
        alive = alive[np.argsort(c[alive], kind="stable")]
        who, place, c = who[alive], place[alive], c[alive]
        order = np.argsort(bwt, kind="stable").astype(np.int32)
        fresh = np.zeros(len(bwt), bool)
        fresh[place] = True
        r = np.flatnonzero(fresh[order])
        before, after = order[r - 1], order[np.minimum(r + 1, len(bwt) - 1)]
        with_before = (r > 0) & (bwt[before] == c)
        with_after = (r + 1 < len(bwt)) & (bwt[after] == c)
        least = _least(lcp, np.concatenate([np.where(with_before, before, place - 1), place]) + 1, np.concatenate([place, np.where(with_after, after, place + 1)]) + 1)
        least = np.minimum(least + np.uint8(1), np.uint8(cap))
        own, nxt = least[: len(place)] * with_before, least[len(place) :] * with_after
        new = r + (m - len(bwt) + np.count_nonzero(bwt))
        old = np.ones(len(bwt) + len(new), bool)
        old[new] = False
        pairs2 = np.empty(len(old), np.uint16)
        pairs2[old] = pairs
        # the neighbour's common prefix is with this suffix now; a neighbour inserted in this round gets its own below, which is the same
        inner = new + 1 < len(old)
        pairs2[new[inner] + 1] = _pairs(pairs2[new[inner] + 1].astype(np.uint8), np.where(with_after, nxt, 0)[inner])
        pairs2[new] = _pairs(symbol(who, done), own)
        file = _File(pairs2)
        place = new
    pairs = file.read()
    return pairs.astype(np.uint8), (pairs >> 8).astype(np.uint8)


def _pairs(symbols: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    return symbols | prefixes.astype(np.uint16) << np.uint16(8)


def _least(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of x over [lo, hi), from minima over powers of two; what lies beyond the end counts as the last element."""
    level = np.frexp((hi - lo).astype(np.float64))[1] - 1
    table = np.empty((int(level.max(initial=0)) + 1, len(x)), np.uint8)
    table[0] = x
    for k in range(1, len(table)):
        reach = 1 << (k - 1)
        np.minimum(table[k - 1, :-reach], table[k - 1, reach:], out=table[k, :-reach])
        table[k, -reach:] = table[k - 1, -reach:]
    flat, row, last = table.ravel(), level.astype(np.int64) * len(x), len(x) - 1
    return np.minimum(flat[row + np.minimum(lo, last)], flat[row + np.minimum(hi - (1 << level), last)])


def places(bwt: np.ndarray, m: int, lengths: np.ndarray, least: int) -> dict[int, np.ndarray]:
    """For suffix lengths from `least` up: the place of each string's suffix of that length (-1: the string is shorter)."""
    order = np.argsort(bwt, kind="stable")
    step = np.empty(len(bwt), np.int64)
    step[order] = np.arange(len(bwt))
    step += m - int((bwt == 0).sum())
    at, out = np.arange(m), {}
    for done in range(1, int(lengths.max(initial=0)) + 1):
        at = np.where(lengths >= done, step[np.maximum(at, 0)], -1)
        if done >= least:
            out[done] = at
    return out
