"""Dirichlet densities and mixtures as priors of counts: posterior means, training, text form."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from reedbank.kernels.special import digamma, lgamma

STEP, EPS = 0.001, 1e-6


def _count_loglik(f: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    """log probability of each row of counts under a Dirichlet-multinomial, without the multinomial coefficient."""
    n, a = f.sum(-1), alpha.sum()
    return lgamma(a) - lgamma(n + a) + (lgamma(f + alpha) - lgamma(alpha)).sum(-1)


def _gradient(f: np.ndarray, alpha: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """By log alpha."""
    a, n = alpha.sum(), f.sum(1)
    return alpha * (weight.sum() * (digamma(a) - digamma(alpha)) + (weight[:, None] * (digamma(f + alpha) - digamma(n + a)[:, None])).sum(0))


def moment_alpha(f: np.ndarray) -> np.ndarray:
    """From means and variances of the rows' shares; the scale comes from the first category that gives a positive one."""
    p = f / np.maximum(f.sum(1, keepdims=True), 1e-12)
    mean, var = p.mean(0), p.var(0)
    for m, v in zip(mean, var, strict=True):
        if v > 0 and m * (1 - m) / v - 1 > 0:
            return np.maximum(mean * (m * (1 - m) / v - 1), 1e-3)
    return np.maximum(mean, 1e-3)


@dataclass
class Mixture:
    """q[j]: shares of components; alpha[j]: their parameters.  One component is a plain density."""

    q: np.ndarray
    alpha: np.ndarray
    cost: float = np.nan

    @classmethod
    def density(cls, alpha) -> Mixture:
        return cls(np.ones(1), np.atleast_2d(np.asarray(alpha, float)))

    def component_posterior(self, f: np.ndarray) -> np.ndarray:
        f = np.atleast_2d(f)
        with np.errstate(divide="ignore"):
            x = np.log(self.q)[None, :] + np.stack([_count_loglik(f, a) for a in self.alpha], 1)
        x = np.exp(x - x.max(1, keepdims=True))
        return x / x.sum(1, keepdims=True)

    def posterior_mean(self, f: np.ndarray) -> np.ndarray:
        """Expected frequencies given counts, row by row."""
        one = np.ndim(f) == 1
        f = np.atleast_2d(np.asarray(f, float))
        w = self.component_posterior(f)
        means = (f[:, None, :] + self.alpha[None]) / (f.sum(1)[:, None, None] + self.alpha.sum(1)[None, :, None])
        out = (w[:, :, None] * means).sum(1)
        return out[0] if one else out

    def loglik(self, f: np.ndarray) -> float:
        with np.errstate(divide="ignore"):
            x = np.log(self.q)[None, :] + np.stack([_count_loglik(np.atleast_2d(f), a) for a in self.alpha], 1)
        top = x.max(1, keepdims=True)
        return float((np.log(np.exp(x - top).sum(1)) + top[:, 0]).sum())


def train(f: np.ndarray, components: int = 1, seed: int = 0, most: int = 500, eps: float = EPS, step: float = STEP) -> Mixture:
    """Maximum likelihood by EM over components and gradient ascent in log alpha; a step that makes it worse is halved."""
    f = np.asarray(f, float)
    f = f[f.sum(1) > 0]
    if not len(f):
        raise ValueError("no counts to train from")
    rng = np.random.default_rng(seed)
    base = moment_alpha(f)
    alpha = np.stack([base * (rng.gamma(2.0, 0.5, f.shape[1]) if components > 1 else 1.0) for _ in range(components)])
    now = Mixture(np.full(components, 1 / components), np.maximum(alpha, 1e-6))
    value = now.loglik(f)
    for _ in range(most):
        w = now.component_posterior(f)
        grad = np.stack([_gradient(f, a, w[:, j]) for j, a in enumerate(now.alpha)]) / len(f)
        size, better = 64 * step, False
        while size > step / 1024:
            tried = Mixture(np.maximum(w.mean(0), 1e-12) / np.maximum(w.mean(0), 1e-12).sum(), np.clip(now.alpha * np.exp(np.clip(size * grad * 10, -1, 1)), 1e-8, 1e8))
            new = tried.loglik(f)
            if new > value:
                better = True
                break
            size /= 2
        if not better:
            break
        done = new - value < eps * max(1.0, abs(value))
        now, value = tried, new
        if done:
            break
    now.cost = -value
    return now


def train_best(f: np.ndarray, components: int, seeds: int, **more) -> Mixture:
    """The best of several starts."""
    return min((train(f, components, s, **more) for s in range(seeds)), key=lambda m: m.cost)


@dataclass
class Prior:
    """Priors of a profile: match and insert emissions (4), and transitions from M (3), I (2), D (2)."""

    match: Mixture
    insert: Mixture
    from_match: Mixture
    from_insert: Mixture
    from_delete: Mixture

    #: Section titles of the text form.
    TITLES = (("match", "Match emission"), ("insert", "Insert emission"), ("from_match", "Match transition"), ("from_insert", "Insert transition"), ("from_delete", "Delete transition"))

    @classmethod
    def flat(cls) -> Prior:
        d = Mixture.density
        return cls(d(np.full(4, 0.5)), d(np.full(4, 1.0)), d([7.0, 0.1, 0.1]), d([1.0, 1.0]), d([1.0, 1.0]))

    def write(self) -> str:
        out = []
        for field, title in self.TITLES:
            m = getattr(self, field)
            k, n = m.alpha.shape[1], len(m.q)
            out.append(f"{title}:")
            out.append(f"Dirichlet {'Density' if n == 1 else 'Mixture'} Model")
            out.append(f"K: {k}" + (f" L: {n}" if n > 1 else ""))
            out.append(f"Trained cost: {m.cost:.10g}")
            if n > 1:
                out.append("q: " + " ".join(f"{x:.10g}" for x in m.q))
            out += ["alpha:" if n > 1 else "alpha: " + " ".join(f"{x:.10g}" for x in m.alpha[0])]
            if n > 1:  # categories are rows, components columns
                out += [" ".join(f"{x:.10g}" for x in row) for row in m.alpha.T]
        return "\n".join(out) + "\n"

    @classmethod
    def read(cls, text: str) -> Prior:
        lines = [x.strip() for x in text.splitlines() if x.strip()]
        found, at = {}, 0
        titles = {t: f for f, t in cls.TITLES}
        current: dict | None = None
        while at < len(lines):
            line = lines[at]
            at += 1
            title = line.rstrip(":")
            if title in titles:
                current = found.setdefault(titles[title], {"cost": np.nan})
            elif current is None:
                continue
            elif line.startswith("K:"):
                current["k"] = int(line.split()[1])
                current["l"] = int(line.split()[3]) if "L:" in line else 1
            elif line.startswith("L:"):
                current["l"] = int(line.split()[1])
            elif "cost" in line:
                current["cost"] = float(line.split(":")[1])
            elif line.startswith("q:"):
                current["q"] = np.array([float(x) for x in line[2:].split()])
            elif line.startswith("alpha"):
                numbers = [float(x) for x in line.partition(":")[2].split()]
                while len(numbers) < current["k"] * current.get("l", 1) and at < len(lines):
                    numbers += [float(x) for x in lines[at].split()]
                    at += 1
                current["alpha"] = np.array(numbers)
        made = {}
        for field, x in found.items():
            n = x.get("l", 1)
            alpha = x["alpha"].reshape(x["k"], n).T if n > 1 else x["alpha"][None, :]
            made[field] = Mixture(x.get("q", np.full(n, 1 / n)), alpha, x["cost"])
        return cls(**made)
