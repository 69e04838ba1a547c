"""DNA substitution models with mean rate one, discrete gamma rates, and their text forms.

Bases are in the order A, C, G, T.  All models give transition probabilities for arrays of branch lengths at once."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from reedbank.kernels.special import gamma_p, gamma_p_inverse

A, C, G, T = range(4)


def _is_transition() -> np.ndarray:
    out = np.zeros((4, 4), bool)
    for i, j in ((A, G), (C, T)):
        out[i, j] = out[j, i] = True
    return out


TRANSITION = _is_transition()


@dataclass
class Model:
    """A reversible model: exchange rates R (symmetric) and base frequencies pi; Q has mean rate one."""

    kind: str
    pi: np.ndarray
    rates: np.ndarray
    values: dict = field(default_factory=dict)

    def __post_init__(self):
        self.pi = np.asarray(self.pi, float)
        self.rates = np.asarray(self.rates, float)
        if not (self.pi > 0).all() or abs(self.pi.sum() - 1) > 1e-6:
            raise ValueError("base frequencies must be positive and sum to 1")
        off = self.rates[~np.eye(4, dtype=bool)]
        if not (np.isfinite(off).all() and (off >= 0).all() and (off > 0).any()):
            raise ValueError("rates must be finite and not negative")
        q = self.rates * self.pi[None, :]
        np.fill_diagonal(q, 0)
        np.fill_diagonal(q, -q.sum(1))
        self.q = q / -(self.pi * np.diag(q)).sum()
        # a reversible Q is similar to a symmetric matrix
        root = np.sqrt(self.pi)
        w, u = np.linalg.eigh(root[:, None] * self.q / root[None, :])
        self._w, self._left, self._right = w, u / root[:, None], u.T * root[None, :]

    def spectrum(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(w, left, right): probabilities after v are left diag(exp(w v)) right."""
        return self._w, self._left, self._right

    def probability(self, v) -> np.ndarray:
        """(..., 4, 4): [from, to] after branches of length v."""
        v = np.asarray(v, float)
        return np.clip(np.einsum("ik,...k,kj->...ij", self._left, np.exp(v[..., None] * self._w), self._right), 0.0, 1.0)

    def distance(self, counts) -> float:
        """Distance of two sequences from their 4 x 4 counts of paired bases; infinite where they are saturated."""
        counts = np.asarray(counts, float)
        n = counts.sum()
        if not n:
            return math.nan
        p = counts / n
        if self.kind == "JC69":
            x = 1 - 4 / 3 * (1 - np.trace(p))
            return -0.75 * math.log(x) if x > 0 else math.inf
        if self.kind == "K80":
            ti, tv = p[TRANSITION].sum(), 1 - np.trace(p) - p[TRANSITION].sum()
            x, y = 1 - 2 * ti - tv, 1 - 2 * tv
            return -0.5 * math.log(x) - 0.25 * math.log(y) if x > 0 and y > 0 else math.inf
        if self.kind == "F81":
            b = 1 - (self.pi**2).sum()
            x = 1 - (1 - np.trace(p)) / b
            return -b * math.log(x) if x > 0 else math.inf
        # the general reversible estimate: -trace(Pi log P), with P from the symmetrised counts
        joint = (p + p.T) / 2
        pi = joint.sum(1)
        if (pi <= 0).any():
            return math.inf
        root = np.sqrt(pi)
        w, u = np.linalg.eigh(joint / root[:, None] / root[None, :])
        if (w <= 0).any():
            return math.inf
        log_p = (u / root[:, None]) @ np.diag(np.log(w)) @ (u.T * root[None, :])
        return float(-(pi * np.diag(log_p)).sum())


def jc69() -> Model:
    return Model("JC69", np.full(4, 0.25), np.ones((4, 4)))


def k80(kappa: float) -> Model:
    return Model("K80", np.full(4, 0.25), np.where(TRANSITION, kappa, 1.0), {"kappa": kappa})


def f81(pi) -> Model:
    return Model("F81", pi, np.ones((4, 4)))


def hky85(pi, kappa: float) -> Model:
    return Model("HKY85", pi, np.where(TRANSITION, kappa, 1.0), {"kappa": kappa})


def tn93(pi, kr: float, ky: float) -> Model:
    rates = np.ones((4, 4))
    rates[A, G] = rates[G, A] = kr
    rates[C, T] = rates[T, C] = ky
    return Model("TN93", pi, rates, {"kr": kr, "ky": ky})


def gtr(pi, rates) -> Model:
    return Model("GTR", pi, (np.asarray(rates) + np.asarray(rates).T) / 2)


def train(kind: str, pair_counts: np.ndarray, pi) -> Model:
    """A model from summed counts of paired bases of close sequences, and base frequencies."""
    counts = np.asarray(pair_counts, float)
    counts = (counts + counts.T) / 2
    pi = np.asarray(pi, float) / np.sum(pi)
    # changes by opportunity: expected shares of unordered pairs are proportional to pi_i pi_j
    share = lambda where: counts[where].sum() / max(1e-300, np.outer(pi, pi)[where].sum())
    flat = np.full(4, 0.25)
    tv = ~TRANSITION & ~np.eye(4, dtype=bool)
    pair = lambda i, j: np.array([[{x, y} == {i, j} for y in range(4)] for x in range(4)])
    if kind == "JC69":
        return jc69()
    if kind == "K80":
        even = np.outer(flat, flat)
        return k80((counts[TRANSITION].sum() / even[TRANSITION].sum()) / max(1e-300, counts[tv].sum() / even[tv].sum()))
    if kind == "F81":
        return f81(pi)
    if kind == "HKY85":
        return hky85(pi, share(TRANSITION) / max(1e-300, share(tv)))
    if kind == "TN93":
        return tn93(pi, share(pair(A, G)) / max(1e-300, share(tv)), share(pair(C, T)) / max(1e-300, share(tv)))
    if kind == "GTR":
        rates = np.array([[share(pair(i, j)) if i != j else 0.0 for j in range(4)] for i in range(4)])
        return gtr(pi, rates / max(1e-300, rates.max()))
    raise ValueError(f"unknown model {kind!r}")


# ---- text form: tags at the starts of lines, matrices on the lines below


def write_model(m: Model) -> str:
    row = lambda x: " ".join(f"{v:.10g}" for v in x)
    out = [f"Type: {m.kind}", f"pi: {row(m.pi)}"]
    if m.kind == "GTR":
        out += ["R:", *map(row, m.rates), "Q:", *map(row, m.q)]
    out += [f"{k}: {v:.10g}" for k, v in m.values.items()]
    return "\n".join(out) + "\n"


def read_model(text: str) -> Model:
    values, lines = {}, [x for x in text.splitlines() if x.strip() and not x.startswith("#")]
    i = 0
    while i < len(lines):
        tag, _, rest = lines[i].partition(":")
        tag, rest = tag.strip(), rest.split()
        i += 1
        if tag in ("R", "Q"):
            numbers = [float(x) for x in rest]
            while len(numbers) < 16 and i < len(lines):
                numbers += [float(x) for x in lines[i].split()]
                i += 1
            values[tag] = np.array(numbers).reshape(4, 4)
        elif tag == "Type":
            values[tag] = rest[0]
        else:
            values[tag] = np.array([float(x) for x in rest])
    kind, one = values["Type"], lambda k: float(values[k][0])
    pi = values.get("pi", np.full(4, 0.25))
    pi = pi / pi.sum()
    make = {
        "JC69": lambda: jc69(), "K80": lambda: k80(one("kappa")), "F81": lambda: f81(pi), "HKY85": lambda: hky85(pi, one("kappa")),
        "TN93": lambda: tn93(pi, one("kr"), one("ky")), "GTR": lambda: gtr(pi, values["R"]),
    }
    if kind not in make:
        raise ValueError(f"unknown model {kind!r}")
    return make[kind]()


def gamma_rates(k: int, alpha: float) -> np.ndarray:
    """Mean rates of k equally likely parts of a gamma distribution with mean one (Yang 1994)."""
    if math.isinf(alpha) or k == 1:
        return np.ones(k)
    cuts = [gamma_p_inverse(alpha, i / k) for i in range(k + 1)]
    up_to = np.array([gamma_p(alpha + 1, x) for x in cuts])
    return k * np.diff(up_to)


def gamma_shape(mutations) -> float:
    """By moments; infinite where the variance doesn't exceed the mean, or under two sites."""
    m = np.asarray(mutations, float)
    if len(m) < 2:
        return math.inf
    mean, var = m.mean(), m.var(ddof=1)
    return mean * mean / (var - mean) if var > mean else math.inf
