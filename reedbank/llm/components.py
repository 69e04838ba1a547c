"""Connected components: inside one array, and over a DataFrame of edges."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbank.llm.shared import join_hot, written


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest reachable vertex of each of 0..n-1, for edges a[i] - b[i]."""
    label = np.arange(n)
    while True:
        x, y = label[a], label[b]
        open_ = x != y
        if not open_.any():
            return label
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump


def contract(forests: DataFrame) -> DataFrame:
    """Edges (a, b) with the components of forests, but few of them: each a points to its smallest b, and so do its other b's.

    An a has one b in each forest at most, so its list is as short as the number of forests."""
    lists = forests.groupBy("a").agg(F.collect_set("b").alias("bs")).select("a", "bs", F.array_min("bs").alias("least"))
    others = F.transform(F.array_remove("bs", F.col("least")), lambda x: F.struct(x.alias("a"), F.col("least").alias("b")))
    return lists.select(F.explode(F.concat(F.array(F.struct("a", F.col("least").alias("b"))), others)).alias("e")).select("e.a", "e.b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, label) for every node of edges (a, b: long): label is the component's smallest node.

    Alternating stars: each vertex's larger neighbours go to its smallest one, then each vertex's smaller neighbours do.  Every round works on
    (vertex, neighbour) pairs with a minimum per vertex that is pre-aggregated, and is written to the shared folder; no vertex's neighbours are collected, and
    those of a hub meet its minimum by broadcast."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "stars")
    n_edges = now.count()
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times")).select("u", F.least("u", "m").alias("m"), "times")
        large = join_hot(both.where("v > u"), least, "u", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v"))
        # the vertex itself is linked to its minimum as well
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        large = written(large, "stars")
        # a vertex has as many smaller neighbours as rounds have left it, few after the first
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("times"))
        small = join_hot(large, low, "u", n_edges).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        now = written(small.where("u <> v").distinct(), "stars")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 31))), F.lit(0))).first()
        if state == before:
            break
        before = state
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
