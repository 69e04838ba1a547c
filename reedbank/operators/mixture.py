"""Dirichlet mixtures trained from a table of counts: EM with one job a step.

A step computes, row by row, how likely each component is, and sums what the next parameters need: the likelihood, the components' shares, and their
expectations of digamma differences.  These are components x (categories + 2) numbers whatever the table's size, added up in tasks before anything is shuffled.  The new
parameters follow from them by one step of the fixed point of Dirichlet-multinomial likelihoods, which never makes the likelihood worse, so training stops when it gains
little."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbank.functions.gamma import digamma_sql, log_gamma_sql
from reedbank.kernels import special
from reedbank.kernels.dirichlet import Mixture
from reedbank.session import stored

LEAST, MOST = 1e-8, 1e8


@dataclass
class Step:
    """Parameters, the log-likelihood of the table under them (without multinomial coefficients), and the sums that the next ones follow from."""

    q: np.ndarray
    alpha: np.ndarray
    loglik: float
    share: np.ndarray
    by_category: np.ndarray
    by_total: np.ndarray
    n: int


def _num(x: float) -> str:
    return f"({float(x)!r}D)" if math.isfinite(x) else "double('-Infinity')"


def with_posteriors(counts: DataFrame, columns: list[str], q: np.ndarray, alpha: np.ndarray) -> DataFrame:
    """counts with g: logarithms of the components' shares times likelihoods of the row, top: their largest, and mass: the sum of their exp below top."""
    k = len(q)
    # sums of parameters and counts stand under names, as the expressions have them many times
    named = counts.selectExpr("*", *[f"{c} + {_num(alpha[j, i])} AS _f{j}_{i}" for j in range(k) for i, c in enumerate(columns)], *[f"{' + '.join(columns)} + {_num(alpha[j].sum())} AS _n{j}" for j in range(k)])
    value = lambda j: " + ".join([
        _num((math.log(q[j]) if q[j] > 0 else -math.inf) + math.lgamma(alpha[j].sum()) - sum(math.lgamma(a) for a in alpha[j])),
        *[log_gamma_sql(f"_f{j}_{i}") for i in range(len(columns))], f"-1 * {log_gamma_sql(f'_n{j}')}",
    ])
    out = named.withColumn("g", F.expr(f"array({', '.join(value(j) for j in range(k))})")).withColumn("top", F.array_max("g"))
    return out.withColumn("mass", F.expr(" + ".join(f"exp(g[{j}] - top)" for j in range(k))))


def step(counts: DataFrame, columns: list[str], q: np.ndarray, alpha: np.ndarray) -> Step:
    """One pass over the table: a single job."""
    k, width = len(q), len(columns)
    rows = with_posteriors(counts, columns, q, alpha)
    rows = rows.selectExpr("top + ln(mass) AS loglik", *[f"exp(g[{j}] - top) / mass AS w{j}" for j in range(k)], *[f"_f{j}_{i}" for j in range(k) for i in range(width)], *[f"_n{j}" for j in range(k)])
    sums = ["sum(loglik) AS loglik", "count(*) AS n", *[f"sum(w{j}) AS s{j}" for j in range(k)]]
    sums += [f"sum(w{j} * {digamma_sql(f'_f{j}_{i}')}) AS d{j}_{i}" for j in range(k) for i in range(width)] + [f"sum(w{j} * {digamma_sql(f'_n{j}')}) AS t{j}" for j in range(k)]
    r = rows.agg(*[F.expr(s) for s in sums]).first()
    get = lambda name: r[name] or 0.0
    return Step(
        q, alpha, get("loglik"), np.array([get(f"s{j}") for j in range(k)]), np.array([[get(f"d{j}_{i}") for i in range(width)] for j in range(k)]), np.array([get(f"t{j}") for j in range(k)]), r.n
    )


def following(s: Step) -> tuple[np.ndarray, np.ndarray]:
    """The next shares and parameters."""
    above = s.by_category - s.share[:, None] * special.digamma(s.alpha)
    below = s.by_total - s.share * special.digamma(s.alpha.sum(1))
    with np.errstate(divide="ignore", invalid="ignore"):
        moved = s.alpha * above / below[:, None]
    # a component without a share stays as it is
    alpha = np.where((s.share[:, None] > 0) & np.isfinite(moved), np.clip(moved, LEAST, MOST), s.alpha)
    return s.share / s.share.sum(), alpha


def start(counts: DataFrame, columns: list[str], components: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Equal shares, and parameters around those that fit the means and variances of the rows' shares."""
    total = " + ".join(columns)
    r = counts.where(f"{total} > 0").agg(*[F.expr(f"{f}({c} / ({total})) AS {f}{i}") for i, c in enumerate(columns) for f in ("avg", "var_pop")]).first()
    mean, var = ([r[f"{f}{i}"] or 0.0 for i in range(len(columns))] for f in ("avg", "var_pop"))
    sizes = [m * (1 - m) / v - 1 for m, v in zip(mean, var, strict=True) if v > 0 and m * (1 - m) / v > 1]
    base = np.maximum(np.array(mean) * (sizes[0] if sizes else 1.0), 1e-3)
    rng = np.random.default_rng(seed)
    alpha = np.stack([base * (rng.gamma(2.0, 0.5, len(columns)) if components > 1 else 1.0) for _ in range(components)])
    return np.full(components, 1 / components), np.maximum(alpha, 1e-6)


def fit(counts: DataFrame, columns: list[str], components: int = 1, seed: int = 0, most: int = 200, eps: float = 1e-6, begin: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Mixture, list[Step]]:
    """The mixture, and the steps that led to it.  Rows with a null or negative count are an error, rows without counts are left out; training ends after most steps, or when
    the likelihood gains less than eps of itself."""
    bad = " OR ".join(f"{c} IS NULL OR {c} < 0" for c in columns)
    rows = counts.selectExpr(*[f"double(if({bad}, raise_error('a count is null or negative'), {c})) AS _c{i}" for i, c in enumerate(columns)])
    names = [f"_c{i}" for i in range(len(columns))]
    rows = stored(rows.where(f"{' + '.join(names)} > 0"), "mixture_counts")
    q, alpha = begin or start(rows, names, components, seed)
    steps: list[Step] = []
    for _ in range(most):
        steps.append(step(rows, names, np.asarray(q, float), np.asarray(alpha, float)))
        if not steps[-1].n:
            raise ValueError("no counts to train from")
        if len(steps) > 1 and steps[-1].loglik - steps[-2].loglik < eps * max(1.0, abs(steps[-1].loglik)):
            break
        q, alpha = following(steps[-1])
    last = max(steps, key=lambda s: s.loglik)
    return Mixture(last.q, last.alpha, -last.loglik), steps
