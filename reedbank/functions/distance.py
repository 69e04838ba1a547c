"""Distances between sequences, and model-corrected ones."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sites(a: Column, b: Column) -> Column:
    return F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b"))


def p_distance(a: Column, b: Column, symbols: str = "ACGT") -> Column:
    """Differing sites over the sites where both have a symbol; null where there are none."""
    both = F.filter(_sites(F.upper(a), F.upper(b)), lambda s: s["a"].rlike(f"^[{symbols}]$") & s["b"].rlike(f"^[{symbols}]$"))
    return F.try_divide(F.size(F.filter(both, lambda s: s["a"] != s["b"])).cast("double"), F.size(both))


def string_distance(a: Column, b: Column) -> Column:
    """Differing characters over the length; null for empty strings."""
    return F.try_divide(F.size(F.filter(_sites(a, b), lambda s: ~s["a"].eqNullSafe(s["b"]))).cast("double"), F.length(a))


def jc69(p: Column) -> Column:
    """Jukes and Cantor 1969; null beyond saturation."""
    return F.when(p < 0.75, -0.75 * F.ln(1 - 4 * p / 3))


def k80(p: Column, q: Column) -> Column:
    """Kimura 1980, from the shares of transitions (p) and transversions (q); null beyond saturation."""
    x, y = 1 - 2 * p - q, 1 - 2 * q
    return F.when((x > 0) & (y > 0), -0.5 * F.ln(x) - 0.25 * F.ln(y))


def jc69_probability(v: Column) -> tuple[Column, Column]:
    """(same base, a given other base) after a branch of length v."""
    e = F.exp(-4 * v / 3)
    return (1 + 3 * e) / 4, (1 - e) / 4
