"""Exact search of the nearest of many short aligned rows, that compares few of them.

Columns are cut into segments of eight.  If a share t of the columns that two rows have in common differ, then in some segment at most a share t of those in common differ,
or none are in common.  So once all rows have been seen that in some segment differ by a share of up to t, no other is as near as t.  Rows are kept in the order of each
segment's letters; segments' letters are gone through from the most similar on, and the search ends as soon as the last of the best is as near as what has been seen."""

from __future__ import annotations

import functools

import numpy as np

#: Columns of a segment, in two halves; values of a half and of a segment (four bases and gap); columns of a word.
COLUMNS, HALF, WORD = 8, 5**4, 32
ALL = HALF**2
#: Up to which shares segments are gone through, a step after the other; the last of the best ends a step sooner.
STEPS = (0.125, 1 / 3, 0.5, 1.0)
GAP = 4


@functools.cache
def _tables() -> tuple[np.ndarray, ...]:
    """(letters of halves; where a relative value leads from a half without gaps; differing and common columns of two halves; high and low halves of relative values by their shares;
    these shares)."""
    digits = np.stack(np.unravel_index(np.arange(HALF), (5,) * 4), axis=1)
    a, b = digits[:, None], digits[None]
    moved = np.where(b == GAP, GAP, (a + b) % 4) @ np.array([125, 25, 5, 1])
    both = (a != GAP) & (b != GAP)
    differ = ((a != b) & both).sum(axis=2).astype(np.int8)
    common = both.sum(axis=2).astype(np.int8)
    share = _share(differ[0][:, None] + differ[0], common[0][:, None] + common[0]).ravel()
    order = np.argsort(share, kind="stable")
    return digits, moved.astype(np.int32), differ, common, (order // HALF).astype(np.int16), (order % HALF).astype(np.int16), share[order]


def _share(differ: np.ndarray, common: np.ndarray) -> np.ndarray:
    """0 where nothing is in common."""
    return differ / np.maximum(common, 1)


def _digits(codes: np.ndarray) -> np.ndarray:
    """codes (below 0: gap) filled up to whole segments."""
    out = np.full((len(codes), -(-codes.shape[1] // COLUMNS) * COLUMNS), GAP, np.int8)
    out[:, : codes.shape[1]] = np.where(codes < 0, GAP, codes)
    return out


def _words(digits: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Letters by two bits, and one bit for each that isn't a gap."""
    letters, some = [], []
    for at in range(0, digits.shape[1], WORD):
        x, y = np.zeros(len(digits), np.uint64), np.zeros(len(digits), np.uint64)
        for k, column in enumerate(digits[:, at : at + WORD].T):
            x |= (column & 3).astype(np.uint64) << np.uint64(2 * k)
            y |= (column != GAP).astype(np.uint64) << np.uint64(2 * k)
        letters.append(x)
        some.append(y)
    return letters, some


def _halves(digits: np.ndarray, at: int) -> tuple[np.ndarray, np.ndarray]:
    by = np.array([125, 25, 5, 1], np.int32)
    return digits[:, at : at + 4] @ by, digits[:, at + 4 : at + 8] @ by


class Index:
    """Rows (ids, codes of aligned letters) to be searched; those without a letter are left out.  compared: how many rows have been compared with searched ones."""

    def __init__(self, ids: np.ndarray, codes: np.ndarray):
        some = (codes >= 0).any(axis=1)
        self.ids, self.compared = ids[some], 0
        digits = _digits(codes[some])
        letters, mask = _words(digits)
        # letters and gaps of a row lie side by side, and are fetched together as one value of 16 bytes
        words = [np.stack(x, axis=1).view(np.complex128).ravel() for x in zip(letters, mask, strict=True)]
        self.segments = []
        for at in range(0, digits.shape[1], COLUMNS):
            high, low = _halves(digits, at)
            value = high * HALF + low
            order = np.argsort(value, kind="stable").astype(np.int32)
            begin = np.zeros(ALL + 1, np.int32)
            np.cumsum(np.bincount(value, minlength=ALL), out=begin[1:])
            self.segments.append((order, begin, [x[order] for x in words]))

    def nearest(self, codes: np.ndarray, n: int):
        """(place of the searched row, id, share of differing columns) of the n nearest of each, equal ones by id."""
        digits = _digits(codes)
        letters, mask = _words(digits)
        halves = [_halves(digits, at) for at in range(0, digits.shape[1], COLUMNS)]
        for i in range(len(codes)):
            at, share = self._one([(x[i], y[i]) for x, y in zip(letters, mask, strict=True)], [(int(a[i]), int(b[i])) for a, b in halves], n)
            yield i, self.ids[at], share

    def _one(self, searched: list, halves: list, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, share, last, done, shares = np.empty(0, np.int64), np.empty(0), np.inf, -1.0, {}
        if not n:
            return at, share
        for step in STEPS:
            for k, (order, begin, words) in enumerate(self.segments):
                values = self._values(*halves[k], done, min(step, last), shares, k)
                first = begin[values]
                count = begin[values + 1] - first
                ends = np.cumsum(count)
                if not len(ends) or not ends[-1]:
                    continue
                self.compared += int(ends[-1])
                rows = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
                differ, both = 0, 0
                for x, (letter, mask) in zip(words, searched, strict=True):
                    x = x[rows].view(np.uint64).reshape(-1, 2)
                    y, x = x[:, 1] & mask, x[:, 0] ^ letter
                    both = both + np.bitwise_count(y)
                    x |= x >> np.uint64(1)
                    x &= y
                    differ = differ + np.bitwise_count(x)
                if not both.all():
                    rows, differ, both = rows[both > 0], differ[both > 0], both[both > 0]
                found = differ / both
                most = last
                if np.isinf(most) and len(found) > n:
                    most = np.partition(found, n - 1)[n - 1]
                near = np.flatnonzero(found <= most)
                if not len(near):
                    continue
                at, of = np.unique(np.r_[at, order[rows[near]]], return_index=True)
                share = np.r_[share, found[near]][of]
                best = np.lexsort((self.ids[at], share))[:n]
                at, share = at[best], share[best]
                if len(at) == n:
                    last = share[-1]
            done = min(step, last)
            if last <= done:
                break
        return at, share

    def _values(self, high: int, low: int, above: float, upto: float, shares: dict, k: int) -> np.ndarray:
        """Values of segment k of which a share over above, up to upto, differs from the searched one's."""
        digits, moved, differ, common, highs, lows, by = _tables()
        if (digits[high] < GAP).all() and (digits[low] < GAP).all():
            a, b = np.searchsorted(by, [above, upto], "right")
            return moved[high][highs[a:b]] * HALF + moved[low][lows[a:b]]
        if k not in shares:
            shares[k] = _share(differ[high][:, None] + differ[low], common[high][:, None] + common[low]).ravel()
        return np.flatnonzero((shares[k] > above) & (shares[k] <= upto))
