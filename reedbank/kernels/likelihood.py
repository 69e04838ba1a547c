"""Likelihoods on trees: messages along directed edges, ancestral states, branch lengths, and placing a sequence.

A message is a 4 x L array of log-likelihoods.  up[u] is what lies below u, as seen from its parent; down[u] is all the rest of the tree, as seen from
u, standing at u's parent.  Gaps (code below 0) have log base frequencies, so they say nothing."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from reedbank.kernels.models import Model
from reedbank.kernels.special import log_sum_exp

NONE = -1
MIN_LENGTH, EPS, MOST_STEPS, MOST_PENDANT = 1e-5, 1e-5, 100, 1.0


def leaf_message(codes: np.ndarray, model: Model) -> np.ndarray:
    out = np.where(np.arange(4)[:, None] == codes[None, :], 0.0, -np.inf)
    return np.where(codes[None, :] < 0, np.log(model.pi)[:, None], out)


def through(message: np.ndarray, p: np.ndarray) -> np.ndarray:
    """log(P exp(message)), shifted by the columns' maxima."""
    top = message.max(axis=-2, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(p @ np.exp(message - top)) + top


def convolve(messages: list[np.ndarray], lengths, model: Model, rates: np.ndarray | None = None) -> np.ndarray:
    """Sum of messages through their branches; with rates, the mean over categories of rates."""
    if rates is None or len(rates) == 1:
        r = 1.0 if rates is None else rates[0]
        return sum(through(m, model.probability(v * r)) for m, v in zip(messages, lengths, strict=True))
    parts = np.stack([sum(through(m, model.probability(v * r)) for m, v in zip(messages, lengths, strict=True)) for r in rates])
    return log_sum_exp(parts, axis=0) - np.log(len(rates))


@dataclass
class Tree:
    """parent[i] (-1 for the root) and length[i] of the branch to it; codes[i] of leaves."""

    parent: np.ndarray
    length: np.ndarray
    codes: np.ndarray

    def __post_init__(self):
        n = len(self.parent)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(self.parent):
            if p >= 0:
                self.children[p].append(i)
        self.root = int(np.flatnonzero(np.asarray(self.parent) < 0)[0])
        order, stack = [], [self.root]
        while stack:
            u = stack.pop()
            order.append(u)
            stack += self.children[u]
        self.preorder = order

    def is_leaf(self, u: int) -> bool:
        return not self.children[u]


def messages(tree: Tree, model: Model, rates: np.ndarray | None = None, sites: slice = slice(None)) -> tuple[dict, dict]:
    """(up, down) in one pass from the leaves and one from the root."""
    up, down = {}, {}
    for u in reversed(tree.preorder):
        kids = tree.children[u]
        up[u] = convolve([up[c] for c in kids], [tree.length[c] for c in kids], model, rates) if kids else leaf_message(tree.codes[u][sites], model)
    for u in tree.preorder:
        for c in tree.children[u]:
            others = [x for x in tree.children[u] if x != c]
            parts, lengths = [up[x] for x in others], [tree.length[x] for x in others]
            if u != tree.root:
                parts, lengths = [*parts, down[u]], [*lengths, tree.length[u]]
            down[c] = convolve(parts, lengths, model, rates) if parts else np.zeros_like(up[c])
    return up, down


def tree_loglik(message_at_root: np.ndarray, model: Model) -> float:
    return float(log_sum_exp(np.log(model.pi)[:, None] + message_at_root, axis=0).sum())


def infer_states(message: np.ndarray) -> np.ndarray:
    return np.argmax(message, axis=0).astype(np.int8)


def state_weights(message: np.ndarray) -> np.ndarray:
    return np.exp(message - log_sum_exp(message, axis=0)[None, :])


def node_message(tree: Tree, up: dict, down: dict, u: int, model: Model, rates=None) -> np.ndarray:
    """What the whole tree says about node u."""
    return up[u] if u == tree.root else up[u] + convolve([down[u]], [tree.length[u]], model, rates)


def ancestral_sequences(tree: Tree, model: Model, rates=None) -> np.ndarray:
    """Codes of all nodes: leaves as they are, inner nodes' most likely bases given the whole tree."""
    up, down = messages(tree, model, rates)
    out = np.array(tree.codes, dtype=np.int8, copy=True)
    for u in tree.preorder:
        if tree.children[u]:
            out[u] = infer_states(node_message(tree, up, down, u, model, rates))
    return out


def mismatch_length(u: np.ndarray, v: np.ndarray, method: str = "unweighted") -> float:
    """A branch's length as the share of sites whose states differ; weighted by how sure the states are."""
    differ = infer_states(u) != infer_states(v)
    if method == "unweighted":
        return float(differ.mean())
    if method != "weighted":
        raise ValueError(f"unknown method {method!r}")
    w = state_weights(u).max(0) * state_weights(v).max(0)
    return float((differ * w).sum() / w.sum())


def optimise_length(u: np.ndarray, v: np.ndarray, model: Model, start: float, most: float = np.inf) -> float:
    """EM for the length between two messages, on q = exp(-w); sites without a finite likelihood are left out."""
    log_pi = np.log(model.pi)[:, None]
    same = log_sum_exp(log_pi + u + v, axis=0)
    apart = log_sum_exp(log_pi + u, axis=0) + log_sum_exp(log_pi + v, axis=0)
    ok = np.isfinite(same - apart) | (np.isneginf(same) & np.isfinite(apart))
    if not ok.any():
        return start
    ratio = np.exp(np.minimum(same[ok] - apart[ok], 700.0))
    p = 1 - np.exp(-max(start, MIN_LENGTH))
    w = start
    for _ in range(MOST_STEPS):
        p = float(np.mean(p / (ratio * (1 - p) + p)))
        before, w = w, min(most, -np.log(max(1 - p, 1e-300)))
        p = 1 - np.exp(-w)
        if abs(w - before) < EPS or p <= 0:
            break
    return max(0.0, float(w))


#: Nodes that a block of reads is compared with at a time.
NODES_AT_ONCE = 8192


def distances(reads: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """p-distances of all reads and nodes (codes, below 0 for anything that isn't a base): sites that differ over sites where both have a base, NaN
    without any.  Counts are matrix products of indicator matrices, one for each base."""
    has = lambda x: (x >= 0).astype(np.float32)
    both = has(reads) @ has(nodes).T
    same = sum((reads == b).astype(np.float32) @ (nodes == b).astype(np.float32).T for b in range(4))
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(both > 0, (both - same).astype(np.float64) / both, np.nan)


@dataclass
class Placement:
    child: int
    parent: int
    ratio: float
    pendant: float
    loglik: float
    length: float = 0.0
    node: int = -1
    anno_dist: float = 0.0


class Placer:
    """Seed, estimate, filter and place, for one tree whose messages are known."""

    def __init__(self, tree: Tree, model: Model, rates=None, heights: np.ndarray | None = None, sequences: np.ndarray | None = None):
        self.tree, self.model, self.rates = tree, model, rates
        self.up, self.down = messages(tree, model, rates)
        self.sequences = ancestral_sequences(tree, model, rates) if sequences is None else sequences
        self.heights = node_heights(tree) if heights is None else heights

    def seeds(self, codes: np.ndarray, start: int, end: int, n: int, max_diff: float = np.inf, max_height: float = np.inf) -> list[tuple[int, float]]:
        """The n nearest nodes (not the root) on sites start..end (half open), by p-distance, then node; nodes without common sites are left out."""
        x, nodes = codes[start:end], self.sequences[:, start:end]
        both = (x >= 0)[None, :] & (nodes >= 0)
        sites = both.sum(1)
        with np.errstate(invalid="ignore", divide="ignore"):
            d = np.where(sites > 0, ((x[None, :] != nodes) & both).sum(1) / sites, np.nan)
        ok = ~np.isnan(d) & (self.heights <= max_height)
        ok[self.tree.root] = False
        at = np.flatnonzero(ok)
        at = at[np.lexsort((at, d[at]))]
        if len(at) and np.isfinite(max_diff):
            at = at[d[at] - d[at[0]] <= max_diff]
        return [(int(u), float(d[u])) for u in at[:n]]

    def seeds_of(self, reads: list[tuple[np.ndarray, int, int]], n: int, max_diff: float = np.inf, max_height: float = np.inf) -> list[list[tuple[int, float]]]:
        """seeds() of several reads (codes, start, end) at once: distances to blocks of nodes are matrix products over the columns that the reads cover."""
        if not reads:
            return []
        lo, hi = min(r[1] for r in reads), max(r[2] for r in reads)
        codes = np.full((len(reads), hi - lo), NONE, np.int8)
        for i, (x, a, z) in enumerate(reads):
            codes[i, a - lo : z - lo] = x[a:z]
        usable = np.flatnonzero(self.heights <= max_height)
        usable = usable[usable != self.tree.root]
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, int), np.zeros(0)) for _ in reads]
        for at in range(0, len(usable), NODES_AT_ONCE):
            nodes = usable[at : at + NODES_AT_ONCE]
            d = distances(codes, self.sequences[nodes, lo:hi])
            for i, row in enumerate(d):
                ok = np.flatnonzero(~np.isnan(row))
                ids, far = np.r_[found[i][0], nodes[ok]], np.r_[found[i][1], row[ok]]
                best = np.lexsort((ids, far))[:n]
                found[i] = ids[best], far[best]
        return [[(int(u), float(d)) for u, d in zip(ids, far, strict=True) if d - far[0] <= max_diff or not np.isfinite(max_diff)] for ids, far in found]

    def _distance(self, codes, u, start, end) -> float:
        x, y = codes[start:end], self.sequences[u][start:end]
        both = (x >= 0) & (y >= 0)
        return float((x != y)[both].mean()) if both.any() else np.nan

    def estimate(self, codes: np.ndarray, u: int, start: int, end: int, method: str = "unweighted") -> Placement:
        v, w0 = int(self.tree.parent[u]), float(self.tree.length[u])
        du, dv = self._distance(codes, u, start, end), self._distance(codes, v, start, end)
        ratio = du / (du + dv) if du + dv > 0 else 0.5
        s = slice(start, end)
        r = convolve([self.up[u][:, s], self.down[u][:, s]], [w0 * ratio, w0 * (1 - ratio)], self.model)
        leaf = leaf_message(codes[s], self.model)
        pendant = mismatch_length(r, leaf, method)
        loglik = tree_loglik(r + convolve([leaf], [pendant], self.model), self.model)
        return Placement(u, v, ratio, pendant, loglik, w0)

    def refine(self, codes: np.ndarray, p: Placement, start: int, end: int, max_height: float = np.inf) -> Placement:
        """Alternate the pendant branch and the place on the branch until neither moves; then the likelihood at the new node."""
        s, w0 = slice(start, end), p.length
        a, b, leaf = self.up[p.child][:, s], self.down[p.child][:, s], leaf_message(codes[s], self.model)
        wu, wn = w0 * p.ratio, p.pendant
        for _ in range(MOST_STEPS):
            at = convolve([a, b], [wu, w0 - wu], self.model)
            new_n = optimise_length(at, leaf, self.model, wn, MOST_PENDANT)
            other = convolve([b, leaf], [w0 - wu, new_n], self.model)
            new_u = optimise_length(a, other, self.model, wu, w0) if w0 > 0 else 0.0
            moved = max(abs(new_n - wn), abs(new_u - wu))
            wn, wu = new_n, new_u
            if moved < EPS:
                break
        loglik = tree_loglik(convolve([a, b, leaf], [wu, w0 - wu, wn], self.model, self.rates), self.model)
        ratio = wu / w0 if w0 > 0 else 0.5
        near_child = ratio <= 0.5 or self.heights[p.parent] > max_height
        return Placement(p.child, p.parent, ratio, wn, loglik, w0, p.child if near_child else p.parent, (w0 * ratio if near_child else w0 * (1 - ratio)) + wn)

    def place(self, codes: np.ndarray, start: int, end: int, n: int = 50, max_error: float = 20.0, max_diff: float = np.inf, max_height: float = np.inf, method: str = "unweighted", seeds: list | None = None) -> list[Placement]:
        """Refined placements, best first; seeds: those of seeds_of, where they are known."""
        seeds = self.seeds(codes, start, end, n, max_diff, max_height) if seeds is None else seeds
        found = [self.estimate(codes, u, start, end, method) for u, _ in seeds]
        if not found:
            return []
        best = max(p.loglik for p in found)
        kept = [self.refine(codes, p, start, end, max_height) for p in found if best - p.loglik <= max_error]
        return sorted(kept, key=lambda p: (-p.loglik, p.child))

    def chimera(self, codes: np.ndarray, start: int, end: int, segments: int = 2, n: int = 50, max_error: float = 20.0, method: str = "unweighted") -> tuple[float, int, int] | None:
        """(log odds, assigned node of the 5' half, of the 3' half): how much better the halves fit at their own best branches than at each other's."""
        size = (end - start) // segments
        if size < 1:
            return None
        halves: list[list] = [[], []]
        for k in range(segments):
            a = start + k * size
            z = end if k == segments - 1 else a + size
            got = self.place(codes, a, z, n, max_error / segments, method=method)
            halves[k >= segments // 2] += [(p, a, z) for p in got]
        if not halves[0] or not halves[1]:
            return None
        (five, a5, z5), (three, a3, z3) = (max(h, key=lambda x: (x[0].loglik, -x[0].child)) for h in halves)
        swapped5 = self.refine(codes, self.estimate(codes, three.child, a5, z5, method), a5, z5)
        swapped3 = self.refine(codes, self.estimate(codes, five.child, a3, z3, method), a3, z3)
        return five.loglik - swapped5.loglik + three.loglik - swapped3.loglik, five.node, three.node


def node_heights(tree: Tree) -> np.ndarray:
    out = np.full(len(tree.parent), np.inf)
    for u in reversed(tree.preorder):
        out[u] = 0.0 if tree.is_leaf(u) else min(out[c] + tree.length[c] for c in tree.children[u])
    return out


def posteriors(loglik, taxa, most: float = 250.0) -> tuple[np.ndarray, np.ndarray]:
    """(q of each placement, q of its taxon) among a read's placements."""
    x = np.asarray(loglik, float)
    e = np.exp(x - x.max())
    total = e.sum()
    of_taxon = np.array([e[[t == u for u in taxa]].sum() for t in taxa])

    def q(rest):
        with np.errstate(divide="ignore"):
            return np.minimum(most, np.where(rest > 0, -10 * np.log10(np.maximum(rest, 1e-300) / total), most))

    return q(total - e), q(total - of_taxon)
