"""Mixtures trained from tables against densities in one process, and expressions of gamma functions against the standard library."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbank.kernels import dirichlet, special


def test_gamma_functions(spark):
    from reedbank.functions import gamma

    xs = [1e-8, 1e-3, 0.1, 0.5, 1.0, 1.5, 2.0, 7.3, 50.0, 1e4, 1e8, 0.0, -1.0]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", gamma.log_gamma("x").alias("g"), gamma.digamma("x").alias("d")).collect()
    for r in rows:
        if r.x > 0:
            assert math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-11, abs_tol=1e-11) and math.isclose(r.d, special.digamma(r.x), rel_tol=1e-11, abs_tol=1e-11)
        else:
            assert r.g is None and r.d is None


def drawn(seed=0, n=400):
    rng = np.random.default_rng(seed)
    kinds = np.array([[8.0, 1, 1], [1, 1, 8]])
    return np.stack([rng.multinomial(rng.integers(5, 40), rng.dirichlet(kinds[int(rng.random() < 0.3)])) for _ in range(n)])


def test_steps_gain_and_find_the_components(spark):
    from reedbank.operators import mixture

    f = drawn()
    rows = spark.createDataFrame([tuple(map(int, x)) for x in f] + [(0, 0, 0)], "a int, b int, c int").repartition(3)
    made, steps = mixture.fit(rows, ["a", "b", "c"], 2, most=25, eps=1e-5)
    assert all(b.loglik >= a.loglik - 1e-7 for a, b in zip(steps, steps[1:], strict=False)) and steps[0].n == len(f)
    assert math.isclose(-made.cost, made.loglik(f.astype(float)), rel_tol=1e-9)
    order = np.argsort(made.alpha[:, 0] / made.alpha.sum(1))
    share = made.alpha / made.alpha.sum(1, keepdims=True)
    # the fixed point is slow, so parameters are on their way after 25 steps
    assert abs(made.q[order[0]] - 0.3) < 0.08 and share[order[0], 2] > 0.6 and share[order[1], 0] > 0.6
    # no worse than ascent in one process
    assert made.cost < dirichlet.train(f, 2).cost * 1.01


def test_one_component_and_bad_rows(spark):
    from reedbank.operators import mixture

    f = drawn(1, 60)
    rows = spark.createDataFrame([tuple(map(float, x)) for x in f], "a double, b double, c double")
    _, steps = mixture.fit(rows, ["a", "b", "c"], most=2)
    assert math.isclose(steps[0].loglik, dirichlet.Mixture.density(steps[0].alpha[0]).loglik(f.astype(float)), rel_tol=1e-10)
    with pytest.raises(ValueError, match="no counts"):
        mixture.fit(rows.where("a < 0"), ["a", "b", "c"])
    for bad in (F.lit(None).cast("double"), F.lit(-1.0)):
        with pytest.raises(Exception, match="null or negative"):
            mixture.fit(rows.withColumn("b", bad), ["a", "b", "c"])
