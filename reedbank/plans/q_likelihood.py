"""Queries of tree likelihoods as tables: a tree whose leaves have the aligned rows, under Jukes and Cantor's model."""

from pyspark.sql import functions as F

from reedbank.kernels.models import jc69
from reedbank.operators import contraction, tree
from reedbank.plans.fixtures import fx_aln, fx_node, with_
from reedbank.plans.registry import query
from reedbank.session import meet

#: Levels of the tree that the SQL is unrolled to; at scale factor 0.1 it has 15.
LEVELS = 18
_L = [f"l{x}" for x in range(4)]


def _msg(prefix: str, length: str, x: int) -> str:
    """The message of a likelihood (prefix.l0 to l3) through a branch."""
    e = f"exp(-4.0::DOUBLE / 3 * {length})"
    total = " + ".join(f"{prefix}.l{y}" for y in range(4))
    return f"((0.25::DOUBLE - 0.25::DOUBLE * {e}) * ({total}) + {e} * {prefix}.l{x})"


def _scaled(columns: str, source: str) -> str:
    top = "greatest(l0, l1, l2, l3)"
    return f"SELECT {columns}, {', '.join(f'{v} / {top} AS {v}' for v in _L)}, ls + ln({top}) AS ls FROM ({source})"


def _up(k: int) -> str:
    own = ", ".join(f"CASE WHEN base = '-' THEN 0.25::DOUBLE WHEN base = '{b}' THEN 1.0::DOUBLE WHEN base IS NOT NULL THEN 0.0::DOUBLE ELSE product({_msg('c', 'c.length', x)}) END AS l{x}" for x, b in enumerate("ACGT"))
    child = f"u{k + 1}" if k + 1 < LEVELS else "(SELECT NULL::BIGINT AS parent, NULL::INT AS site, 0.0::DOUBLE AS length, 0.0::DOUBLE AS l0, 0.0::DOUBLE AS l1, 0.0::DOUBLE AS l2, 0.0::DOUBLE AS l3, 0.0::DOUBLE AS ls)"
    source = f"SELECT n.id, n.site, n.parent, n.length, {own}, coalesce(sum(c.ls), 0) AS ls FROM n LEFT JOIN {child} c ON c.parent = n.id AND c.site = n.site WHERE lv = {k} GROUP BY n.id, n.site, n.parent, n.length, base"
    return f"u{k} AS MATERIALIZED ({_scaled('id, site, parent, length', source)})"


def _down(k: int) -> str:
    above = "1.0::DOUBLE" if k == 1 else "{}"
    values = ", ".join(f"coalesce({_msg('s', 's.length', x)}, 1.0::DOUBLE) * {above.format(_msg('d', 'p.length', x))} AS l{x}" for x in range(4))
    joins = "" if k == 1 else f" JOIN d{k - 1} d ON d.id = p.id AND d.site = p.site"
    source = f"SELECT c.id, c.site, {values}, 0.0::DOUBLE AS ls FROM u{k} c JOIN u{k - 1} p ON p.id = c.parent AND p.site = c.site LEFT JOIN u{k} s ON s.parent = c.parent AND s.site = c.site AND s.id <> c.id{joins}"
    return f"d{k} AS MATERIALIZED ({_scaled('id, site', source)})"


_SITES = """n AS (SELECT f.id, parent, f.length, length(bin(f.id)) - 1 AS lv, s::INT AS site, CASE WHEN f.id NOT IN (SELECT parent FROM fx_node WHERE parent IS NOT NULL) THEN substr(aln, s::INT, 1) END AS base
  FROM fx_node f JOIN fx_aln a ON a.id = f.id, LATERAL (SELECT unnest(range(1, 33)) AS s))"""
_UP = f"{with_('fx_node', 'fx_aln')}, {_SITES},\n" + ",\n".join(_up(k) for k in reversed(range(LEVELS)))
_W = [f"round(p{x} / (p0 + p1 + p2 + p3), 9)" for x in range(4)]
_BEST = f"greatest({', '.join(_W)})"


def _tables(spark, d):
    nodes = fx_node(spark, d).select("id", "parent", "length")
    leaves = tree.leaves(nodes).select("id")
    return nodes, meet(fx_aln(spark, d), leaves, "id", "left_semi").select("id", F.col("aln").alias("seq"))


@query(f"{_UP}\nSELECT site, round(ln((l0 + l1 + l2 + l3) / 4) + ls, 6) AS loglik FROM u0")
def tree_loglik(spark, d):
    """Log-likelihood of the whole tree at each site."""
    model = jc69()
    rows = contraction.site_loglik(contraction.root_messages(*_tables(spark, d), model), model)
    return rows.select("site", F.round("loglik", 6).alias("loglik"))


@query(
    f"{_UP},\n" + ",\n".join(_down(k) for k in range(1, LEVELS)) + ",\ne AS (" + " UNION ALL ".join([f"SELECT id, site, {', '.join(f'{v} AS p{x}' for x, v in enumerate(_L))} FROM u0", *[
        f"SELECT u.id, u.site, {', '.join(f'u.l{x} * {_msg("d", "u.length", x)} AS p{x}' for x in range(4))} FROM u{k} u JOIN d{k} d ON d.id = u.id AND d.site = u.site" for k in range(1, LEVELS)
    ]]) + f")\nSELECT id AS node, site, CASE {_BEST} WHEN {_W[0]} THEN 'A' WHEN {_W[1]} THEN 'C' WHEN {_W[2]} THEN 'G' ELSE 'T' END AS base, round(greatest(p0, p1, p2, p3) / (p0 + p1 + p2 + p3), 6) AS weight FROM e"
)
def ancestral_states(spark, d):
    """The most likely base of every node at every site given all leaves, and how likely it is."""
    weights = contraction.weights_of(*_tables(spark, d), jc69())
    return contraction.ancestral_states(weights).select(F.col("id").alias("node"), "site", "base", F.round("weight", 6).alias("weight"))
