"""Candidate placements of reads: slack filters, posteriors and the best one, all as windows over (read)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reedbank.functions.numeric import Q_MOST


def top_candidates(candidates: DataFrame, n: int, distance: str = "dist", read: str = "read", node: str = "node") -> DataFrame:
    """The n nearest nodes of each read, unknown distances last, equal ones by node."""
    order = Window.partitionBy(read).orderBy(F.col(distance).asc_nulls_last(), node)
    return candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def within_distance(candidates: DataFrame, slack: float, distance: str = "dist", read: str = "read") -> DataFrame:
    return candidates.withColumn("__best", F.min(distance).over(Window.partitionBy(read))).where(F.col(distance) - F.col("__best") <= slack).drop("__best")


def within_loglik(candidates: DataFrame, slack: float, loglik: str = "loglik", read: str = "read") -> DataFrame:
    return candidates.withColumn("__best", F.max(loglik).over(Window.partitionBy(read))).where(F.col("__best") - F.col(loglik) <= slack).drop("__best")


def _quality(rest: Column, whole: Column) -> Column:
    """-10 log10 of the share that rest has of whole, at most Q_MOST; rest is summed without the own term, so it is exact near 0."""
    return F.when(rest <= 0, F.lit(Q_MOST)).otherwise(F.least(F.lit(Q_MOST), -10 * F.log10(rest / whole)))


def posteriors(candidates: DataFrame, loglik: str = "loglik", read: str = "read", taxon: str = "taxon", prior: Column | None = None) -> DataFrame:
    """Adds q_placement and q_taxon: how sure the placement, and its taxon, are among the read's candidates."""
    by_read, by_taxon = Window.partitionBy(read), Window.partitionBy(read, taxon)
    x = candidates.withColumn("__x", F.col(loglik) + prior if prior is not None else F.col(loglik))
    x = x.withColumn("__e", F.exp(F.col("__x") - F.max("__x").over(by_read)))
    x = x.withColumn("__all", F.sum("__e").over(by_read)).withColumn("__taxon", F.sum("__e").over(by_taxon))
    out = x.withColumn("q_placement", _quality(F.col("__all") - F.col("__e"), F.col("__all"))).withColumn("q_taxon", _quality(F.col("__all") - F.col("__taxon"), F.col("__all")))
    return out.drop("__x", "__e", "__all", "__taxon")


def best(candidates: DataFrame, *order: Column, read: str = "read") -> DataFrame:
    """One candidate for each read, the first in the given order, which must leave no ties."""
    return candidates.withColumn("__k", F.row_number().over(Window.partitionBy(read).orderBy(*order))).where(F.col("__k") == 1).drop("__k")


def height_prior(anno_dist: Column, pendant: Column, height: Column) -> Column:
    return -(anno_dist - pendant + height)


def annotation_distance(ratio: Column, length: Column, pendant: Column) -> Column:
    return F.when(ratio <= 0.5, length * ratio).otherwise(length * (1 - ratio)) + pendant
