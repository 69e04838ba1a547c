"""Training of mixtures over a table: parts by the status of their order lines."""

import numpy as np
from pyspark.sql import functions as F

from reedbank.functions import gamma
from reedbank.operators import mixture
from reedbank.plans.fixtures import table
from reedbank.plans.registry import query

_KINDS = [("A", "F"), ("N", "F"), ("N", "O"), ("R", "F")]
_STEPS = 5
Q0, A0 = [0.5, 0.3, 0.2], [[1.0, 0.5, 2.0, 1.0], [4.0, 1.0, 4.0, 3.0], [0.6, 0.2, 0.9, 1.4]]


def _counts(spark, d):
    kind = lambda a, b: F.count_if((F.col("l_returnflag") == a) & (F.col("l_linestatus") == b))
    return table(spark, d, "lineitem").groupBy("l_partkey").agg(*[kind(*k).alias(f"c{i}") for i, k in enumerate(_KINDS)])


_C = "c AS (SELECT l_partkey AS id, " + ", ".join(f"count(*) FILTER (l_returnflag = '{a}' AND l_linestatus = '{b}')::DOUBLE AS c{i}" for i, (a, b) in enumerate(_KINDS)) + " FROM lineitem GROUP BY l_partkey)"
_P0 = "p0(k, q, a0, a1, a2, a3) AS (VALUES " + ", ".join(f"({k}, {q}::DOUBLE, {', '.join(f'{x}::DOUBLE' for x in a)})" for k, (q, a) in enumerate(zip(Q0, A0, strict=True))) + ")"


def _em(t: int) -> str:
    total, psi = "(a0 + a1 + a2 + a3)", gamma.digamma_sql
    value = f"ln(q) + lgamma({total}) - lgamma(n + {total}) + " + " + ".join(f"lgamma(c{i} + a{i}) - lgamma(a{i})" for i in range(4))
    moved = ", ".join(f"any_value(a{i}) * sum(w * ({psi(f'(c{i} + a{i})')} - {psi(f'a{i}')})) / sum(w * ({psi(f'(n + {total})')} - {psi(total)})) AS a{i}" for i in range(4))
    return f"""g{t} AS MATERIALIZED (SELECT c.*, c0 + c1 + c2 + c3 AS n, p.*, {value.replace("n +", "(c0 + c1 + c2 + c3) +")} AS g FROM c, p{t} p WHERE c0 + c1 + c2 + c3 > 0),
w{t} AS MATERIALIZED (SELECT *, exp(g - max(g) OVER r) / sum(exp(g - m)) OVER r AS w FROM (SELECT *, max(g) OVER (PARTITION BY id) AS m FROM g{t}) WINDOW r AS (PARTITION BY id)),
v{t} AS MATERIALIZED (SELECT sum(l) AS loglik, count(*) AS n FROM (SELECT max(g) + ln(sum(exp(g - m))) AS l FROM (SELECT *, max(g) OVER (PARTITION BY id) AS m FROM g{t}) GROUP BY id)),
p{t + 1} AS MATERIALIZED (SELECT k, sum(w) / (SELECT n FROM v{t}) AS q, {moved} FROM w{t} GROUP BY k)"""


@query(
    f"WITH {_C}, {_P0}, " + ",\n".join(_em(t) for t in range(_STEPS)) + "\n"
    + "\nUNION ALL ".join(f"SELECT {t} AS step, k AS component, round(q, 6) AS q, " + ", ".join(f"round(a{i}, 5) AS a{i}" for i in range(4)) + f", round((SELECT loglik FROM v{t}), 4) AS loglik FROM p{t}" for t in range(_STEPS))
)
def mixture_em(spark, d):
    """Five steps of training a mixture of three components, from a fixed start: parameters and likelihood of each."""
    _, steps = mixture.fit(_counts(spark, d), [f"c{i}" for i in range(4)], most=_STEPS, eps=-1.0, begin=(np.array(Q0), np.array(A0)))
    # a row for each step and component: the model's parameters
    rows = [(t, k, float(s.q[k]), *map(float, s.alpha[k]), float(s.loglik)) for t, s in enumerate(steps) for k in range(len(Q0))]
    out = spark.createDataFrame(rows, "step int, component int, q double, a0 double, a1 double, a2 double, a3 double, loglik double")
    return out.select("step", "component", F.round("q", 6).alias("q"), *[F.round(f"a{i}", 5).alias(f"a{i}") for i in range(4)], F.round("loglik", 4).alias("loglik"))


@query("""WITH v AS (SELECT p_partkey AS id, (p_size / 7.0)::DOUBLE + 0.01::DOUBLE AS x, p_retailprice::DOUBLE / 100 AS y FROM part)
SELECT id, round(lgamma(x), 8) AS lx, round(lgamma(y), 6) AS ly, round(lgamma(x) + lgamma(y) - lgamma(x + y), 6) AS beta FROM v""")
def log_gamma(spark, d):
    """Log gamma and log beta of numbers from 0.01 on."""
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("id"), ((F.col("p_size") / F.lit(7.0)).cast("double") + 0.01).alias("x"), (F.col("p_retailprice").cast("double") / 100).alias("y"))
    rows = rows.withColumn("z", F.col("x") + F.col("y"))
    lx, ly, lz = (gamma.log_gamma(c) for c in "xyz")
    return rows.select("id", (F.round(lx, 8) + 0.0).alias("lx"), F.round(ly, 6).alias("ly"), (F.round(lx + ly - lz, 6) + 0.0).alias("beta"))


_CATEGORIES = range(2, 9)


@query(f"""WITH RECURSIVE s AS (SELECT DISTINCT (p_size / 10.0)::DOUBLE AS a FROM part), k AS (SELECT unnest(range(2, 9)) AS k),
cut(a, k, i, low, high, step) AS (SELECT a, k, i, 0.0::DOUBLE, least(a + 10 * sqrt(a) + 20, 60), 0 FROM s, k, LATERAL (SELECT unnest(range(1, k)) AS i)
  UNION ALL SELECT a, k, i, CASE WHEN under THEN mid ELSE low END, CASE WHEN under THEN high ELSE mid END, step + 1
  FROM (SELECT *, (low + high) / 2 AS mid, list_sum(list_transform(range(0, 220), lambda n: exp((a + n) * ln((low + high) / 2) - (low + high) / 2 - lgamma(a + n + 1)))) < i / k AS under FROM cut WHERE step < 60)),
p AS (SELECT a, k, i, list_sum(list_transform(range(0, 220), lambda n: exp((a + 1 + n) * ln((low + high) / 2) - (low + high) / 2 - lgamma(a + n + 2)))) AS p FROM cut WHERE step = 60
  UNION ALL SELECT a, k, 0, 0.0 FROM s, k UNION ALL SELECT a, k, k, 1.0 FROM s, k),
r AS (SELECT a, k, i, (p - lag(p) OVER (PARTITION BY a, k ORDER BY i)) * k AS rate FROM p)
SELECT p_partkey AS id, k::INT AS categories, i::INT AS category, round(rate, 8) + 0.0 AS rate FROM part JOIN r ON r.a = (p_size / 10.0)::DOUBLE WHERE i > 0""")
def gamma_rates(spark, d):
    """Mean rates of 2 to 8 categories of a gamma distribution, for a shape from each part's size."""
    shapes = table(spark, d, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") / F.lit(10.0)).alias("shape"))
    out = None
    for k in _CATEGORIES:
        one = gamma.discrete_rates(shapes, k).select("id", F.lit(k).alias("categories"), F.posexplode("rates").alias("category", "rate"))
        out = one if out is None else out.unionByName(one)
    return out.select("id", "categories", (F.col("category") + 1).alias("category"), (F.round("rate", 8) + 0.0).alias("rate"))


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, l_quantity / 10 AS a, l_tax * 100 + 0.5 AS b, l_linenumber::DOUBLE AS c, l_extendedprice AS x, l_quantity * 500 AS y, 10000.0 AS z FROM lineitem),
w AS (SELECT *, x / (x + y + z) AS p, y / (x + y + z) AS q, z / (x + y + z) AS r FROM v)
SELECT l_orderkey, l_linenumber, round(lgamma(a + b + c) - lgamma(a) - lgamma(b) - lgamma(c) + (a - 1) * ln(p) + (b - 1) * ln(q) + (c - 1) * ln(r), 6) AS log_density FROM w""")
def dirichlet_pdf(spark, d):
    """Log densities of shares under the parameters of their rows."""
    v = table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "double(l_quantity) / 10 AS a", "double(l_tax) * 100 + 0.5D AS b", "double(l_linenumber) AS c", "double(l_extendedprice) AS x", "double(l_quantity) * 500 AS y", "10000.0D AS z")
    w = v.selectExpr("*", "x / (x + y + z) AS p", "y / (x + y + z) AS q", "z / (x + y + z) AS r")
    return w.select("l_orderkey", "l_linenumber", F.round(F.expr(gamma.dirichlet_log_density(["a", "b", "c"], ["p", "q", "r"])), 6).alias("log_density"))
