"""Counts that substitution models are trained from: base pairs of sibling sequences, inferred ancestors, mutations by site."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PURINES, PYRIMIDINES = ("A", "G"), ("C", "T")


def sibling_sequences(siblings: DataFrame, sequences: DataFrame, seq_id: str = "id", seq: str = "seq") -> DataFrame:
    """(parent, a, b, seq_a, seq_b)"""
    s = sequences.select(F.col(seq_id).alias("k"), F.col(seq).alias("s"))
    one = siblings.join(s.withColumnsRenamed({"k": "a", "s": "seq_a"}), "a")
    return one.join(s.withColumnsRenamed({"k": "b", "s": "seq_b"}), "b")


def pair_sites(pairs: DataFrame, *names: str) -> DataFrame:
    """One row for each site where all the named sequences have a base; columns b0, b1, ..."""
    zipped = F.arrays_zip(*[F.split(F.upper(F.col(n)), "").alias(f"b{i}") for i, n in enumerate(names)])
    sites = pairs.select("*", F.posexplode(zipped).alias("site", "x")).select(*[c for c in pairs.columns if c not in names], (F.col("site") + 1).alias("site"), "x.*")
    for i in range(len(names)):
        sites = sites.where(F.col(f"b{i}").isin("A", "C", "G", "T"))
    return sites


def transitions_of_pairs(sites: DataFrame) -> DataFrame:
    """(from_base, to_base, n)"""
    return sites.groupBy(F.col("b0").alias("from_base"), F.col("b1").alias("to_base")).agg(F.count("*").alias("n"))


def transitions_of_triplets(sites: DataFrame, outer: bool = False) -> DataFrame:
    """From an ancestor that two of three (outer, first, second) agree on, to both inner ones, and with outer to the outer one as well; sites where all
    differ don't count."""
    ancestor = F.when((F.col("b0") == F.col("b1")) | (F.col("b0") == F.col("b2")), F.col("b0")).when(F.col("b1") == F.col("b2"), F.col("b1"))
    both = sites.withColumn("from_base", ancestor).where(F.col("from_base").isNotNull())
    return both.select("from_base", F.explode(F.array(*["b0"] * outer, "b1", "b2")).alias("to_base")).groupBy("from_base", "to_base").agg(F.count("*").alias("n"))


def titv(counts: DataFrame) -> DataFrame:
    """One row (n_transitions, n_transversions, ratio)."""
    pair = lambda kinds: F.col("from_base").isin(*kinds) & F.col("to_base").isin(*kinds)
    changed = counts.where("from_base <> to_base")
    sums = changed.agg(F.coalesce(F.sum(F.when(pair(PURINES) | pair(PYRIMIDINES), F.col("n"))), F.lit(0)).alias("n_transitions"), F.coalesce(F.sum(F.when(~(pair(PURINES) | pair(PYRIMIDINES)), F.col("n"))), F.lit(0)).alias("n_transversions"))
    return sums.withColumn("ratio", F.try_divide(F.col("n_transitions").cast("double"), F.col("n_transversions")))


def mutations_by_site(edges_with_seqs: DataFrame, child: str = "seq_a", parent: str = "seq_b") -> DataFrame:
    """(site, n_mutations) over all branches."""
    return pair_sites(edges_with_seqs, child, parent).groupBy("site").agg(F.count_if(F.col("b0") != F.col("b1")).alias("n_mutations"))
