"""Log gamma and digamma of positive numbers as column expressions: the argument is raised by eight, where Stirling's series has twelve right digits, and what that
added is taken off again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RAISED = 8
#: Coefficients of 1/y, 1/y^3, ... of log gamma, and of 1/y^2, 1/y^4, ... of digamma.
_LOG = ("1.0E0/12", "-1.0E0/360", "1.0E0/1260", "-1.0E0/1680", "1.0E0/1188")
_DI = ("-1.0E0/12", "1.0E0/120", "-1.0E0/252", "1.0E0/240", "-1.0E0/132")


def _series(z: str, coefficients: tuple[str, ...]) -> str:
    out = coefficients[-1]
    for c in reversed(coefficients[:-1]):
        out = f"{c} + {z} * ({out})"
    return out


def log_gamma_sql(x: str) -> str:
    """SQL of log gamma of x, which stands in it many times: a column."""
    y = f"({x} + {RAISED})"
    below = " * ".join(f"({x} + {i})" for i in range(RAISED))
    return f"(({y} - 0.5E0) * ln({y}) - {y} + 0.91893853320467274178E0 + ({_series(f'1 / ({y} * {y})', _LOG)}) / {y} - ln({below}))"


def digamma_sql(x: str) -> str:
    y = f"({x} + {RAISED})"
    below = " + ".join(f"1 / ({x} + {i})" for i in range(RAISED))
    z = f"1 / ({y} * {y})"
    return f"(ln({y}) - 0.5E0 / {y} + {z} * ({_series(z, _DI)}) - ({below}))"


def log_gamma(name: str) -> Column:
    """Log gamma of the double column name; null where it isn't positive."""
    return F.expr(f"if({name} > 0, {log_gamma_sql(name)}, NULL)")


def digamma(name: str) -> Column:
    return F.expr(f"if({name} > 0, {digamma_sql(name)}, NULL)")


#: Terms of the series of the incomplete gamma function, enough for arguments up to 60, and halvings of an interval.
TERMS, HALVINGS = 220, 48


def _scaled_series(a: Column, x: Column) -> Column:
    """Sum of x^n / ((a + 1) ... (a + n)), term by term."""
    begin = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def add(s: Column, n: Column) -> Column:
        term = s["term"] * x / (a + n)
        return F.struct(term.alias("term"), (s["total"] + term).alias("total"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), begin, add, lambda s: s["total"])


def gamma_p(a: Column, x: Column, log_gamma_next: Column) -> Column:
    """The regularised lower incomplete gamma function at x up to 60, as its series has only positive terms; log_gamma_next: log gamma of a + 1, a column."""
    return F.when(x <= 0, 0.0).otherwise(F.least(F.exp(a * F.log(x) - x - log_gamma_next) * _scaled_series(a, x), F.lit(1.0)))


def gamma_quantile(a: Column, p: Column, log_gamma_next: Column) -> Column:
    """Where the incomplete gamma function is p, by halving an interval that holds it."""
    begin = F.struct(F.lit(0.0).alias("low"), F.least(a + 10 * F.sqrt(a) + 20, F.lit(60.0)).alias("high"))

    def halve(s: Column, _: Column) -> Column:
        mid = (s["low"] + s["high"]) / 2
        upper, lower = F.struct(mid.alias("low"), s["high"].alias("high")), F.struct(s["low"].alias("low"), mid.alias("high"))
        return F.when(gamma_p(a, mid, log_gamma_next) < p, upper).otherwise(lower)

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), begin, halve, lambda s: (s["low"] + s["high"]) / 2)


def discrete_rates(shapes: DataFrame, categories: int, shape: str = "shape") -> DataFrame:
    """shapes with rates: the mean rates of as many equally likely categories of a gamma distribution of mean 1.  Shapes are above 0 and at most 20; each distinct one is
    worked out once."""
    of = shapes.select(F.col(shape).cast("double").alias("_a")).where("_a > 0 and _a <= 20").distinct().withColumns({"_b": F.col("_a") + 1, "_c": F.col("_a") + 2})
    of = of.withColumns({"_g": log_gamma("_b"), "_h": log_gamma("_c"), "_i": F.explode(F.sequence(F.lit(1), F.lit(categories)))})
    # a row for each category's upper end: few and costly, so they are dealt over all cores
    of = of.repartition(shapes.sparkSession.sparkContext.defaultParallelism)
    of = of.withColumn("_q", F.when(F.col("_i") < categories, gamma_quantile(F.col("_a"), F.col("_i") / categories, F.col("_g"))))
    of = of.withColumn("_p", F.when(F.col("_i") == categories, 1.0).otherwise(gamma_p(F.col("_b"), F.col("_q"), F.col("_h"))))
    ends = of.groupBy("_a").agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_p"))), lambda x: x["_p"]).alias("_ends"))
    rates = F.transform("_ends", lambda x, i: (x - F.when(i > 0, F.get("_ends", i - 1)).otherwise(0.0)) * categories)
    return shapes.withColumn("_a", F.col(shape).cast("double")).join(ends.select("_a", rates.alias("rates")), "_a", "left").drop("_a")


def dirichlet_log_density(alpha: list[str], x: list[str]) -> str:
    """SQL of the log density of shares x (columns) under parameters alpha (columns)."""
    total = "(" + " + ".join(alpha) + ")"
    return f"({log_gamma_sql(total)} + " + " + ".join(f"({a} - 1) * ln({v}) - {log_gamma_sql(a)}" for a, v in zip(alpha, x, strict=True)) + ")"
