"""Discrete gamma rates in expressions against those in one process."""

import math

import numpy as np
import pytest


@pytest.mark.parametrize("k", [1, 2, 5, 8])
def test_rates(spark, k):
    from reedbank.functions import gamma
    from reedbank.kernels import models

    shapes = [0.05, 0.3, 1.0, 2.5, 20.0]
    rows = spark.createDataFrame([(a,) for a in [*shapes, *shapes[:2], -1.0, None]], "shape double")
    got = [(r["shape"], r.rates) for r in gamma.discrete_rates(rows, k).collect()]
    assert len(got) == 9 and all(r is None for a, r in got if a is None or a < 0)
    for a, r in got:
        if r is not None:
            assert np.allclose(r, models.gamma_rates(k, a), atol=1e-9) and math.isclose(sum(r), k)
