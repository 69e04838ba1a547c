"""Chimera scan: for every breakpoint of a read the best node to its left and the best one to its right, from one pass of window functions.

Scores are log-likelihoods by site of a read at each of its candidate nodes.  Their running sums give each candidate's score left of every site, and what is missing to
its total the score right of it; so a maximum over candidates by read and site finds both sides for all breakpoints at once, where fitting segments anew takes two fits a
candidate and breakpoint.  Windows hold one read at one node, sums over candidates are added up in tasks before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedbank.kernels.models import Model
from reedbank.operators.contraction import BASES, FOUR
from reedbank.session import meet

#: Digits that decide between nodes, and fewer between breakpoints, whose scores are sums of two; what agrees in them is equal, and the smaller one stands.
DIGITS, DIGITS_OF_BOTH = 9, 6


def site_scores(reads: DataFrame, weights: DataFrame, model: Model, length: float = 0.01) -> DataFrame:
    """(read, node, site, loglik) of reads (read, node, site, base) at their candidates: the base at the end of a branch of length, given how likely each base
    is at the node (id, site, wa, wc, wg, wt).  Gaps and other letters score 0."""
    p = model.probability(length)
    value = F.lit(0.0)
    for y in reversed(FOUR):
        seen = sum((F.col(f"w{b}") * float(p[x, y]) for x, b in enumerate("acgt")), F.lit(0.0))
        value = F.when(F.col("base") == BASES[y], F.log(seen)).otherwise(value)
    return meet(reads, weights.withColumnRenamed("id", "node"), ["node", "site"]).select("read", "node", "site", value.alias("loglik"))


def scan(scores: DataFrame, least: int = 1) -> DataFrame:
    """(read, site, five, three, gain, lod) of each read with two candidates or more: the last site of the left part of its best breakpoint, with least sites of the
    candidates on either side; the best nodes left and right of it; how much better they are together than the best single node; and how much better than with
    the nodes exchanged.  Of equal breakpoints the first, of equal nodes the smallest.  All candidates of a read should have the same sites."""
    one = W.partitionBy("read", "node")
    upto = one.orderBy("site").rowsBetween(W.unboundedPreceding, W.currentRow)
    sums = scores.select("read", "node", "site", F.sum("loglik").over(upto).alias("left"), F.sum("loglik").over(one).alias("total"), F.row_number().over(one.orderBy("site")).alias("at"), F.count("*").over(one).alias("n"))
    sums = sums.withColumns({"left": F.round("left", DIGITS), "right": F.round(F.col("total") - F.col("left"), DIGITS)})
    best = lambda c: F.max(F.struct(F.col(c).alias("score"), (-F.col("node")).alias("node"), F.col("left").alias("left"), F.col("right").alias("right"))).alias(f"best_{c}")
    cuts = sums.where((F.col("at") >= least) & (F.col("at") <= F.col("n") - least)).groupBy("read", "site").agg(best("left"), best("right"), F.max(F.round("total", DIGITS)).alias("single"), F.count("*").alias("nodes")).where("nodes > 1")
    both = F.round(F.col("best_left.score") + F.col("best_right.score"), DIGITS_OF_BOTH)
    chosen = cuts.groupBy("read").agg(F.max(F.struct(both.alias("both"), (-F.col("site")).alias("site"), "best_left", "best_right", "single")).alias("x"))
    five, three = F.col("x.best_left"), F.col("x.best_right")
    swapped = five["left"] - three["left"] + three["right"] - five["right"]
    return chosen.select("read", (-F.col("x.site")).alias("site"), (-five["node"]).alias("five"), (-three["node"]).alias("three"), (F.col("x.both") - F.col("x.single")).alias("gain"), swapped.alias("lod"))
