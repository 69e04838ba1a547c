"""Elias-Fano sequences that are searched as they are coded.

A non-decreasing sequence of n whole numbers is kept as its low bits, packed, and its high parts in unary, with a count of ones before
each 64-bit word.  Access is a select of a one, search a select of two zeros and a binary search among the few numbers between them; both run on
arrays of queries and decode nothing else.  A sequence is one run of uint64 words, so it can be a view of a mapped file.
"""

from __future__ import annotations

import numpy as np

_ONE, _WORD = np.uint64(1), np.uint64(63)
#: Queries that are answered at a time, so that their temporary arrays stay in cache.
BATCH = 1 << 16


def _or_words(size: int, word: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Words 0..size-1 with the disjoint bits that belong to them; word is non-decreasing."""
    out = np.zeros(size, np.uint64)
    if len(word):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        out[word[first]] = np.bitwise_or.reduceat(bits, first)
    return out


def _nth_one(x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Place of the n-th set bit (from 0) of each word."""
    x, n = x.copy(), n.copy()
    place = np.zeros(len(x), np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        below = np.bitwise_count(x & np.uint64((1 << half) - 1)).astype(np.int64)
        up = n >= below
        n -= np.where(up, below, 0)
        place += up * half
        x >>= (up * half).astype(np.uint64)
    return place


class Monotone:
    """A coded sequence; words: [n, low bits, words of the unary part, words of the low part] and the parts."""

    HEAD = 4

    def __init__(self, words: np.ndarray):
        self.words = words
        self.n, self.bits, upper, low = (int(x) for x in words[: self.HEAD])
        ranks = (upper + 2) // 2
        self.size = self.HEAD + upper + low + ranks
        at = self.HEAD
        self.upper, at = words[at : at + upper], at + upper
        self.low, at = words[at : at + low], at + low
        self.ones = words[at : at + ranks].view(np.uint32)[: upper + 1]
        self.most = 64 * upper

    @classmethod
    def encode(cls, values) -> np.ndarray:
        values = np.asarray(values).astype(np.uint64)
        n = len(values)
        if not n:
            return np.array([0, 0, 0, 0, 0], np.uint64)
        bits = max(0, (int(values[-1]) // n).bit_length() - 1)
        place = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = int(place[-1]) // 64 + 1
        # room for the zero that ends the last high part
        size += (int(place[-1]) + 1) // 64 + 1 - size
        upper = _or_words(size, place >> 6, _ONE << (place & 63).astype(np.uint64))
        low = np.zeros(0, np.uint64)
        if bits:
            x = values & np.uint64((1 << bits) - 1)
            at = np.arange(n) * bits
            word, off = at >> 6, (at & 63).astype(np.uint64)
            low = _or_words(n * bits // 64 + 2, word, x << off)
            over = (off + np.uint64(bits)) > np.uint64(64)
            low[word[over] + 1] |= x[over] >> (np.uint64(64) - off[over])
        ones = np.zeros(2 * ((size + 2) // 2), np.uint32)
        ones[1 : size + 1] = np.cumsum(np.bitwise_count(upper), dtype=np.uint32)
        return np.concatenate([np.array([n, bits, size, len(low)], np.uint64), upper, low, ones.view(np.uint64)])

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.uint64)
        at = i * self.bits
        word, off = at >> 6, (at & 63).astype(np.uint64)
        return ((self.low[word] >> off) | (self.low[word + 1] << (np.uint64(64) - off))) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Place of the k-th one or zero of the unary part."""
        before = 64 * np.arange(len(self.ones)) - self.ones if zeros else self.ones
        word = np.searchsorted(before, k, side="right") - 1
        x = self.upper[word]
        return 64 * word + _nth_one(~x if zeros else x, k - before[word])

    def _batched(self, run, *queries):
        parts = [run(*[q[a : a + BATCH] for q in queries]) for a in range(0, len(queries[0]), BATCH)]
        return parts

    def get(self, i: np.ndarray) -> np.ndarray:
        """Numbers at places i, as int64."""
        i = np.asarray(i, np.int64)
        if not len(i):
            return np.zeros(0, np.int64)
        run = lambda i: ((self._select(i, False) - i) << self.bits) | self._low(i).astype(np.int64)
        return np.concatenate(self._batched(run, i))

    def find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of x among the places lo to hi - 1, and whether it is there."""
        if not len(x) or not self.n:
            return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        parts = self._batched(self._find, np.asarray(x, np.int64), lo, hi)
        return tuple(np.concatenate([p[i] for p in parts]) for i in range(2))

    def _find(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = x >> self.bits
        top = self.most - self.n - 1  # the last zero's number
        ask = np.clip(high, 0, top)
        a = np.where(ask > 0, self._select(np.maximum(ask - 1, 0), True) - ask + 1, 0)
        b = self._select(ask, True) - ask
        a, b = np.maximum(a, lo), np.minimum(b, hi)
        low = x.astype(np.uint64) & np.uint64((1 << self.bits) - 1)
        end = b.copy()
        open_ = np.flatnonzero(a < b)
        while len(open_):
            mid = (a[open_] + b[open_]) >> 1
            less = self._low(mid) < low[open_]
            a[open_[less]] = mid[less] + 1
            b[open_[~less]] = mid[~less]
            open_ = open_[a[open_] < b[open_]]
        hit = (a < end) & (high == ask)
        at = np.where(hit, a, 0)
        hit &= self._low(at) == low
        return at, hit


class Successors:
    """Lists of ascending numbers, one list for each context: pointers to the lists, and the lists one after the other, each moved up by what the one before
    ends with, so that the whole is monotone.  A number is searched relative to its context."""

    @staticmethod
    def encode(starts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """starts: where each context's list begins, and the end of all."""
        values = np.asarray(values).astype(np.int64)
        sizes = np.diff(starts)
        base = np.zeros(len(sizes), np.int64)
        some = sizes > 0
        base[some] = np.r_[0, np.cumsum(values[starts[1:][some] - 1] + 1)[:-1]] if some.any() else 0
        return Monotone.encode(starts), Monotone.encode(values + np.repeat(base, sizes))

    def __init__(self, starts: Monotone, moved: Monotone):
        self.starts, self.moved = starts, moved

    def ranges(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first, end, base) of the lists of contexts."""
        lo, hi = self.starts.get(context), self.starts.get(context + 1)
        base = np.zeros(len(lo), np.int64)
        some = np.flatnonzero((lo > 0) & (lo < hi))
        base[some] = self.moved.get(lo[some] - 1) + 1
        return lo, hi, base

    def find(self, ranges: tuple, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lo, hi, base = ranges
        return self.moved.find(base + x, lo, hi)
