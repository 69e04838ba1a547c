"""Suffix arrays by induced sorting, a batch of suffixes at a time, and permuted common prefixes.

Suffixes are S-type if smaller than the suffix after them, else L-type.  The leftmost S of each stretch (LMS) are sorted by their substrings
through one induction, named, and, if names repeat, ordered by recursion on the text of names.  A second induction gives the whole array: going up
through the characters' buckets, each placed suffix places the L-type suffix before it; going down, the S-type one.  All suffixes of a bucket that are
placed are taken in one step, so the work is linear and the number of steps depends on the alphabet and the longest run of one
character.  The recursion ends at texts of SHORT characters, which are sorted directly.  To keep the alphabet small in the recursion, more than SMALL_ALPHABET names are written as two digits each, to the base of about
the root of their number; names sort as their digits do, and as LMS places are no more than half of all, the text does not grow.

Common prefixes of neighbours in the array are computed in text order.  Where the characters before a suffix and before its neighbour are equal, the length is one less
than that of the suffix before (PLCP), so characters are compared at the other places only.
"""

from __future__ import annotations

import math

import numpy as np

#: Names up to this many are characters themselves.
SMALL_ALPHABET = 1024
#: A text of at most so many characters ends the recursion.
SHORT = 1 << 18
#: Pairs of suffixes that are compared at a time.
PAIRS = 1 << 18


def classify(text: np.ndarray) -> np.ndarray:
    """True for S-type suffixes; the end of the text is smaller than any character."""
    n = len(text)
    small = np.zeros(n, bool)
    if n < 2:
        return small
    rises, falls = text[:-1] < text[1:], text[:-1] > text[1:]
    # equal neighbours take the type of the next change
    change = np.where(rises | falls, np.arange(n - 1, dtype=np.int32), np.int32(n))
    nearest = np.minimum.accumulate(change[::-1])[::-1]
    inside = nearest < n
    small[:-1][inside] = rises[nearest[inside]]
    return small


class _Buckets:
    def __init__(self, text: np.ndarray, small: np.ndarray, symbols: int):
        counts = np.bincount(text, minlength=symbols)
        self.text, self.symbols = text, symbols
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        # the type of the suffix before each; none before the first
        self.before = np.full(len(text), 2, np.int8)
        self.before[1:] = small[:-1]

    def _deal(self, out: np.ndarray, suffixes: np.ndarray, place: np.ndarray, step: int) -> None:
        """Append suffixes to their characters' buckets in order; place: each bucket's next free place."""
        chars = self.text[suffixes]
        if len(chars) == 1:
            c = chars[0]
            out[place[c]] = suffixes[0]
            place[c] += step
            return
        order = chars.argsort(kind="stable")
        chars = chars[order]
        counts = np.bincount(chars, minlength=self.symbols)
        # the n-th of all is so many behind the first of its character
        base = place - step * (counts.cumsum() - counts)
        out[base[chars] + step * np.arange(len(chars))] = suffixes[order]
        place += step * counts

    def induce(self, seeds: np.ndarray) -> np.ndarray:
        """The suffix array, from the LMS suffixes in the order wanted."""
        text, n = self.text, len(self.text)
        out = np.full(n, -1, np.int32)
        tail = self.ends.copy()
        if len(seeds):
            tail -= np.bincount(text[seeds], minlength=self.symbols)
            self._deal(out, seeds, tail.copy(), 1)
        seeds_at = tail
        head = self.starts.copy()
        self._deal(out, np.array([n - 1]), head, 1)  # the last suffix is L-type, before all others of its character
        for c in np.flatnonzero(self.ends > self.starts):
            done = self.starts[c]
            while done < head[c]:
                block = out[done : head[c]]
                done = head[c]
                self._place(out, block, head, 1, 0)
            if seeds_at[c] < self.ends[c]:
                self._place(out, out[seeds_at[c] : self.ends[c]].copy(), head, 1, 0)
        # S-type suffixes are placed anew, from the ends
        tail = self.ends - 1
        for c in np.flatnonzero(self.ends > self.starts)[::-1]:
            done = self.ends[c] - 1
            while done > tail[c]:
                block = out[tail[c] + 1 : done + 1][::-1]
                done = tail[c]
                self._place(out, block, tail, -1, 1)
            if head[c] > self.starts[c]:
                self._place(out, out[self.starts[c] : head[c]][::-1], tail, -1, 1)
        return out

    def _place(self, out: np.ndarray, block: np.ndarray, place: np.ndarray, step: int, kind: int) -> None:
        before = block[self.before[block] == kind]
        if len(before):
            self._deal(out, before - 1, place, step)


def _direct(text: np.ndarray) -> np.ndarray:
    """The suffix array of a short text, by doubling of ranks."""
    rank, n, reach = text.astype(np.int64), len(text), 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - reach] = rank[reach:] + 1
        _, rank = np.unique(rank * (n + 1 + int(rank.max(initial=0))) + after, return_inverse=True)
        reach *= 2
        if int(rank.max()) == n - 1 or reach >= n:
            return np.argsort(rank, kind="stable").astype(np.int32)


def common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many characters the suffixes at a and b have in common, up to most; eight bytes at a time."""
    wide = text.itemsize
    raw = np.concatenate([np.ascontiguousarray(text).view(np.uint8), np.zeros(8, np.uint8)])
    eights = np.ndarray((len(raw) - 7,), "<u8", raw, 0, (1,))
    out = np.zeros(len(a), np.int32)
    for first in range(0, len(a), PAIRS):
        part = slice(first, first + PAIRS)
        left = most[part].astype(np.int64) * wide
        active = np.flatnonzero(left > 0)
        p, q, left = a[part][active].astype(np.int64) * wide, b[part][active].astype(np.int64) * wide, left[active]
        active += first
        while len(active):
            differ = eights[p] ^ eights[q]
            # equal low bytes: the zeros below the lowest set bit
            same = np.where(differ == 0, 8, np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
            same = np.minimum(same, left)
            out[active] += same.astype(np.int32)
            more = (same == 8) & (left > 8)
            active, p, q, left = active[more], p[more] + 8, q[more] + 8, left[more] - 8
    return out // wide


def _order_of_names(names: np.ndarray, n_names: int) -> np.ndarray:
    """Order of the suffixes of a text of names, by recursion on its digits."""
    if n_names <= SMALL_ALPHABET:
        return suffix_array(names, n_names)
    base = math.isqrt(n_names - 1) + 1
    order = suffix_array(np.column_stack([names // base, names % base]).ravel(), base)
    return order[order % 2 == 0] // 2


def suffix_array(text: np.ndarray, symbols: int | None = None) -> np.ndarray:
    """Places of text's suffixes in order; text: non-negative whole numbers."""
    text = np.asarray(text)
    n = len(text)
    if n < 2:
        return np.arange(n)
    if n <= SHORT:
        return _direct(text)
    symbols = int(text.max()) + 1 if symbols is None else symbols
    text = text.astype(np.uint8 if symbols <= 256 else np.uint16 if symbols <= 1 << 16 else np.int64)
    small = classify(text)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    buckets = _Buckets(text, small, symbols)
    del small
    if len(lms) < 2:
        return buckets.induce(lms)
    names, sorted_lms = _names_of(text, lms, buckets.induce(lms))
    n_names = int(names.max()) + 1
    if n_names < len(lms):
        del sorted_lms  # not held while names are sorted
        sorted_lms = lms[_order_of_names(names, n_names)]
    return buckets.induce(sorted_lms)


def _names_of(text: np.ndarray, lms: np.ndarray, rough: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A name for each distinct substring from one LMS place to the next, and the LMS places in the order of their substrings, which rough is sorted by."""
    n = len(text)
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    sorted_lms = rough[is_lms[rough]]
    upto = np.zeros(n, np.int32)
    upto[lms] = np.r_[lms[1:] + 1, n]
    a, b = sorted_lms[:-1], sorted_lms[1:]
    size = upto[a] - a
    same = (size == upto[b] - b) & (upto[a] < n) & (upto[b] < n)
    del is_lms, upto
    at = np.flatnonzero(same)
    same[at] = common_prefixes(text, a[at], b[at], size[at]) == size[at]
    name_of = np.zeros(n, np.int32)
    name_of[sorted_lms] = np.r_[0, np.cumsum(~same)]
    return name_of[lms], sorted_lms


def permuted_lcp(text: np.ndarray, order: np.ndarray, cap: int, fresh: np.ndarray | None = None) -> np.ndarray:
    """By place in the text: length of the prefix that the suffix has in common with the one before it in order.

    Lengths are right up to cap, which has to be as large as any that is asked for plus the distance to the last place of fresh before (sorted; the
    beginning of the text is always one): there characters are compared as well."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    at = np.arange(n, dtype=np.int32)
    # a place follows from the one before it where both have the same character in front, and the one before is not the first in order
    follows = before > 0
    follows[0] = False
    follows[1:] &= (before[:-1] >= 0) & (text[:-1] == text[before[1:] - 1])
    if fresh is not None:
        follows[fresh] = False
    start = np.flatnonzero(~follows)
    own = start[before[start] >= 0]
    value = np.zeros(n, np.int32)
    value[own] = common_prefixes(text, own, before[own], np.minimum(n - np.maximum(own, before[own]), cap))
    head = np.maximum.accumulate(np.where(follows, 0, at))
    return np.maximum(value[head] - (at - head), 0)
