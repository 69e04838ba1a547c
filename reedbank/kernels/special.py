"""Special functions that NumPy lacks: log gamma, digamma, the incomplete gamma function and its inverse; bisection."""

from __future__ import annotations

import math

import numpy as np

lgamma = np.vectorize(math.lgamma, otypes=[float])


def digamma(x):
    """Recurrence up to 10, then the asymptotic series."""
    x = np.asarray(x, float)
    out, y = np.zeros_like(x), x.copy()
    for _ in range(10):
        low = y < 10
        out = np.where(low, out - 1 / y, out)
        y = np.where(low, y + 1, y)
    z = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))


def gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function: series below a + 1, continued fraction above."""
    if x <= 0:
        return 0.0
    if math.isinf(x):
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return min(1.0, total * scale)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / ((an * d + b) or tiny)
        c = (b + an / c) or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return max(0.0, 1 - h * scale)


def gamma_p_inverse(a: float, p: float) -> float:
    if p <= 0:
        return 0.0
    if p >= 1:
        return math.inf
    high = max(1.0, a)
    while gamma_p(a, high) < p:
        high *= 2
    # in logs, as quantiles of small shapes lie close to 0
    low = math.log(high) - 1.0
    while gamma_p(a, math.exp(low)) > p:
        low -= max(1.0, 1 / a)
    return math.exp(bisect(lambda y: gamma_p(a, math.exp(y)) - p, low, math.log(high), 1e-13))


def bisect(f, low: float, high: float, eps: float = 1e-10, most: int = 400) -> float:
    """A root in [low, high] to an absolute or relative eps; NaN where the ends have one sign."""
    a, b = f(low), f(high)
    if a == 0:
        return low
    if b == 0:
        return high
    if not a * b < 0:
        return math.nan
    for _ in range(most):
        mid = (low + high) / 2
        m = f(mid)
        if m == 0 or high - low < eps * max(1.0, abs(mid)):
            return mid
        low, high, a = (mid, high, m) if a * m > 0 else (low, mid, a)
    return (low + high) / 2


def log_sum_exp(x, axis=None):
    x = np.asarray(x, float)
    top = np.max(x, axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.sum(np.exp(x - top), axis=axis, keepdims=True)) + top
    return np.squeeze(out, axis=axis) if axis is not None else float(out.ravel()[0])


def lbeta(a) -> float:
    a = np.asarray(a, float)
    return float(lgamma(a).sum() - math.lgamma(a.sum()))


def dirichlet_logpdf(x, a) -> float:
    return float(((np.asarray(a) - 1) * np.log(x)).sum() - lbeta(a))


def multinomial_logpmf(x, p) -> float:
    x = np.asarray(x, float)
    with np.errstate(divide="ignore", invalid="ignore"):
        terms = np.where(x > 0, x * np.log(p), 0.0)
    return math.lgamma(x.sum() + 1) - float(lgamma(x + 1).sum()) + float(terms.sum())
