"""Scores, log-domain sums and array statistics."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

Q_MOST = 250.0


def p_to_q(p: Column) -> Column:
    """-10 log10 p; infinite quality for 0 is written as Q_MOST."""
    return F.when(p <= 0, F.lit(Q_MOST)).otherwise(-10 * F.log10(p))


def q_to_p(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def log_sum_exp(x: Column, window) -> Column:
    """log of the sum of exponentials over a window, shifted by its maximum."""
    top = F.max(x).over(window)
    return top + F.ln(F.sum(F.exp(x - top)).over(window))


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is computed once a row, however often a lambda in body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def softmax(x: Column) -> Column:
    shifted = let(F.array_max(x), lambda top: F.transform(x, lambda v: F.exp(v - top)))
    return let(shifted, lambda e: let(total(e), lambda s: F.transform(e, lambda v: v / s)))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b.cast("double"))


def which_max(x: Column) -> Column:
    """0-based place of the first largest value."""
    return F.array_position(x, F.array_max(x)) - 1


def count_element(x: Column, value) -> Column:
    return F.size(F.filter(x, lambda v: v == value))


def weighted_total(x: Column, w: Column) -> Column:
    return total(F.zip_with(x, w, lambda a, b: a.cast("double") * b.cast("double")))


def scaled_to_one(x: Column) -> Column:
    return let(total(x), lambda s: F.transform(x, lambda v: F.try_divide(v.cast("double"), s)))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))))


def kl_divergence(p: Column, q: Column) -> Column:
    """In nats; terms with p = 0 are 0."""
    return total(F.zip_with(p, q, lambda x, y: F.when(x > 0, x * F.ln(x / y)).otherwise(F.lit(0.0))))


def relative_entropy(p: Column, q: Column) -> Column:
    return kl_divergence(p, q) / F.ln(F.lit(2.0))


def bhattacharyya(p: Column, q: Column) -> Column:
    return -F.ln(total(F.zip_with(p, q, lambda x, y: F.sqrt(x * y))))


def gamma_shape_by_moments(mutations: Column) -> Column:
    """mean^2 / (variance - mean) as an aggregate; null where the variance doesn't exceed the mean or there are under two sites."""
    mean, var = F.avg(mutations), F.var_samp(mutations)
    return F.when(var > mean, mean * mean / (var - mean))


def per(*keys: str) -> Window:
    return Window.partitionBy(*keys)
