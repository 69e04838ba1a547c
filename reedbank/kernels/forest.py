"""Messages up and down forests whose trees are small, a level at a time for all trees and sites.

Messages are as in kernels.likelihood, but not logarithms: values are scaled to a largest entry of 1, with the logarithm of the scale beside them.  Those that meet at a node are
multiplied as sums of logarithms."""

from __future__ import annotations

import numpy as np

from reedbank.kernels.models import Model

LETTERS = np.full(256, 4, np.int8)
for _i, _b in enumerate(b"ACGT"):
    LETTERS[[_b, _b + 32]] = _i


def letter_messages(texts: list[str | None], width: int, model: Model) -> np.ndarray:
    """(texts, width, 4) of aligned leaves; what isn't a base, or missing, is a gap."""
    raw = np.frombuffer("".join((t or "")[:width].ljust(width, "-") for t in texts).encode("ascii", "replace"), np.uint8)
    return np.vstack([np.eye(4), model.pi])[LETTERS[raw]].reshape(len(texts), width, 4)


def _scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = v.max(axis=-1)
    top = np.where(top > 0, top, 1.0)
    return v / top[..., None], np.log(top)


class Forest:
    """parent: places of the parents (-1 at the top of a tree); length of the branches to them."""

    def __init__(self, parent: np.ndarray, length: np.ndarray, model: Model, rates=None):
        self.w, self.left, self.right = model.spectrum()
        self.rates = np.array([1.0]) if rates is None else np.asarray(rates, float)
        depth, up = (parent >= 0).astype(np.int64), parent.copy()
        for _ in range(len(parent).bit_length() + 1):
            some = up >= 0
            if not some.any():
                break
            depth[some] += depth[up[some]]
            up[some] = up[up[some]]
        else:
            raise ValueError("nodes are their own ancestors")
        #: Places by level, children of one parent side by side.
        self.order = np.lexsort((parent, depth))
        place = np.empty(len(parent), np.int64)
        place[self.order] = np.arange(len(parent))
        up = parent[self.order]
        self.parent = np.where(up >= 0, place[up], -1)
        self.length = length[self.order]
        self.bounds = np.searchsorted(depth[self.order], np.arange(depth.max(initial=0) + 2))

    def _levels(self):
        """(from, to, first child of each parent) of the levels below the top."""
        for a, b in zip(self.bounds[1:-1], self.bounds[2:], strict=True):
            yield int(a), int(b), np.flatnonzero(np.diff(self.parent[a:b], prepend=-2))

    def through(self, v: np.ndarray, a: int, b: int) -> np.ndarray:
        """(nodes, rates, sites, 4) of the messages v of the nodes at places a to b, after their branches."""
        e = np.exp(self.w * self.rates[None, :, None] * self.length[a:b, None, None])
        return np.maximum(((v @ self.right.T)[:, None] * e[:, :, None]) @ self.left.T, 0.0)

    def up(self, l: np.ndarray, ls: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: E741
        """Messages by place, of those of the leaves in l (nodes, sites, 4) and ls (nodes, sites)."""
        l, ls = l[self.order], ls[self.order]  # noqa: E741
        for a, b, first in reversed(list(self._levels())):
            with np.errstate(divide="ignore"):
                g = np.add.reduceat(np.log(self.through(l[a:b], a, b)), first, axis=0)
            at = self.parent[a:b][first]
            top = g.max(axis=(1, 3))
            top = np.where(np.isfinite(top), top, 0.0)
            l[at], more = _scaled(np.exp(g - top[:, None, :, None]).mean(axis=1))
            ls[at] = np.add.reduceat(ls[a:b], first, axis=0) + top + more
        return l, ls

    def down(self, l: np.ndarray, d: np.ndarray, root: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:  # noqa: E741
        """(d, weights, known) by place: what all leaves that aren't below a node say, as seen at its parent; how likely each base is; and whether the rest of the tree is known.

        l: messages by place; d: those of the rest for the tops that are known and no roots."""
        d, root, known = d[self.order], root[self.order], known[self.order]
        weights = np.empty_like(l)
        n = self.bounds[1]
        beyond = np.where(root[:n, None, None, None], 1.0, self.through(d[:n], 0, n))
        weights[:n] = l[:n] * beyond.mean(axis=1)
        before = 0
        for a, b, first in self._levels():
            m = self.through(l[a:b], a, b)
            zero = m <= 0
            logs = np.log(np.where(zero, 1.0, m))
            of = np.repeat(np.arange(len(first)), np.diff(first, append=b - a))
            # without a node's own message; zeros are counted, as they can't be divided out
            g = np.where(np.add.reduceat(zero.astype(np.int32), first, axis=0)[of] > zero, -np.inf, np.add.reduceat(logs, first, axis=0)[of] - logs)
            top = g.max(axis=(1, 3), keepdims=True)
            at = self.parent[a:b]
            d[a:b], _ = _scaled((np.exp(g - np.where(np.isfinite(top), top, 0.0)) * beyond[at - before]).mean(axis=1))
            known[a:b] = known[at]
            beyond, before = self.through(d[a:b], a, b), a
            weights[a:b] = l[a:b] * beyond.mean(axis=1)
        total = weights.sum(axis=-1, keepdims=True)
        # where leaves contradict each other over branches of no length nothing is known
        return d, np.where(total > 0, weights / np.where(total > 0, total, 1.0), 0.25), known
