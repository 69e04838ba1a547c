"""Profiles of multiple alignments, from rows (seq id, aligned text) to columns and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reedbank.session import meet, spread

ID, SEQ, SITE, BASE = "id", "aln", "site", "base"
BASES = ("A", "C", "G", "T")


def long(msa: DataFrame, seq_id: str = ID, aligned: str = SEQ) -> DataFrame:
    """(id, site from 1, base): upper case, '-' for anything that isn't a base."""
    sites = spread(msa.select(seq_id, aligned)).select(F.col(seq_id).alias(ID), F.posexplode(F.split(F.upper(F.col(aligned)), "")).alias("p", "b"))
    return sites.select(ID, (F.col("p") + 1).alias(SITE), F.when(F.col("b").isin(*BASES), F.col("b")).otherwise("-").alias(BASE))


def checked(msa: DataFrame, aligned: str = SEQ) -> DataFrame:
    """One row (n_seqs, n_columns, is_aligned): whether all rows have one length."""
    return msa.agg(F.count("*").alias("n_seqs"), F.max(F.length(aligned)).alias("n_columns"), (F.min(F.length(aligned)) == F.max(F.length(aligned))).alias("is_aligned"))


def column_counts(sites: DataFrame) -> DataFrame:
    return sites.groupBy(SITE, BASE).agg(F.count("*").alias("n"))


def row_extent(msa: DataFrame, seq_id: str = ID, aligned: str = SEQ) -> DataFrame:
    """(id, first, last, n_bases): 1-based columns of the first and last base, null without any."""
    lead = F.length(F.regexp_extract(F.upper(F.col(aligned)), "^[^ACGT]*", 0))
    tail = F.length(F.regexp_extract(F.upper(F.col(aligned)), "[^ACGT]*$", 0))
    n = F.length(F.regexp_replace(F.upper(F.col(aligned)), "[^ACGT]", ""))
    some = lambda c: F.when(n > 0, c)
    return msa.select(F.col(seq_id).alias(ID), some(lead + 1).alias("first"), some(F.length(aligned) - tail).alias("last"), n.alias("n_bases"))


def sequence_weights(sites: DataFrame) -> DataFrame:
    """(id, weight): position-based weights; they sum to the number of sequences with a base."""
    bases = sites.where(F.col(BASE) != "-")
    counts = bases.groupBy(SITE, BASE).agg(F.count("*").alias("n"))
    counts = counts.withColumn("kinds", F.count("*").over(Window.partitionBy(SITE)))
    # four rows for each column of the alignment, whatever its number of sequences
    raw = bases.join(F.broadcast(counts), [SITE, BASE]).groupBy(ID).agg((F.sum(1 / (F.col("kinds") * F.col("n"))) / F.count("*")).alias("w"))
    sums = raw.agg(F.sum("w").alias("all_w"), F.count("*").alias("all_n"))
    return raw.crossJoin(F.broadcast(sums)).select(ID, (F.col("w") / F.col("all_w") * F.col("all_n")).alias("weight"))


def with_weights(sites: DataFrame, weights: DataFrame) -> DataFrame:
    """sites with the weights of their sequences, which are as many as the input and never broadcast."""
    return meet(sites, weights, ID)


def weighted_counts(sites: DataFrame, weights: DataFrame) -> DataFrame:
    return with_weights(sites, weights).groupBy(SITE, BASE).agg(F.sum("weight").alias("w"))


def consensus(counts: DataFrame, value: str = "n", gaps_win: bool = True) -> DataFrame:
    """(site, consensus): the base with the largest value, first in A, C, G, T among equals; a gap where gaps weigh more than it."""
    of = {b: F.coalesce(F.sum(F.when(F.col(BASE) == b, F.col(value))), F.lit(0)) for b in (*BASES, "-")}
    wide = counts.groupBy(SITE).agg(*[c.alias("gap" if b == "-" else b) for b, c in of.items()])
    top = F.greatest(*BASES)
    out = F.when(F.col("gap") > top, F.lit("-")) if gaps_win else F.when(F.lit(False), F.lit("-"))
    for b in BASES:
        out = out.when(F.col(b) == top, F.lit(b))
    return wide.select(SITE, out.alias("consensus"))


def column_fractions(sites: DataFrame) -> DataFrame:
    """(site, identity, gap_fraction, symbol_fraction): the most frequent base, gaps and bases over all sequences."""
    of = lambda b: F.count_if(F.col(BASE) == b)
    n = F.count("*")
    return sites.groupBy(SITE).agg((F.greatest(*[of(b) for b in BASES]) / n).alias("identity"), (of("-") / n).alias("gap_fraction"), (1 - of("-") / n).alias("symbol_fraction"))


def weighted_fractions(weighted: DataFrame) -> DataFrame:
    """(site, identity, gap_fraction, symbol_fraction) of weighted_counts: the heaviest base over all, gaps and bases over all, by weight."""
    of = lambda b: F.coalesce(F.sum(F.when(F.col(BASE) == b, F.col("w"))), F.lit(0.0))
    n = F.sum("w")
    return weighted.groupBy(SITE).agg((F.greatest(*[of(b) for b in BASES]) / n).alias("identity"), (of("-") / n).alias("gap_fraction"), (1 - of("-") / n).alias("symbol_fraction"))


def base_frequencies(sites: DataFrame) -> DataFrame:
    sums = sites.where(F.col(BASE) != "-").groupBy(BASE).agg(F.count("*").alias("n"))
    return sums.withColumn("frequency", F.col("n") / F.sum("n").over(Window.partitionBy()))


def match_columns(sites: DataFrame, least: float = 0.5) -> DataFrame:
    """(site, symbol_fraction) of columns with enough bases."""
    return sites.groupBy(SITE).agg((F.count_if(F.col(BASE) != "-") / F.count("*")).alias("symbol_fraction")).where(F.col("symbol_fraction") >= least)


def prune(sites: DataFrame) -> DataFrame:
    """Sites of columns that have any base, numbered anew from 1."""
    kept = sites.groupBy(SITE).agg(F.count_if(F.col(BASE) != "-").alias("n")).where("n > 0")
    # one row for each column of the alignment, whatever its number of sequences
    numbered = kept.select(SITE, F.row_number().over(Window.orderBy(SITE)).alias("new_site"))
    return sites.join(F.broadcast(numbered), SITE)


def profile_index(fractions: DataFrame, least: float = 0.5) -> DataFrame:
    """(site, is_match, profile): running number of match columns up to each column."""
    flag = (F.col("symbol_fraction") >= least).cast("int")
    return fractions.select(SITE, flag.alias("is_match"), F.sum(flag).over(Window.orderBy(SITE).rowsBetween(Window.unboundedPreceding, 0)).alias("profile"))


def map_gaps(matches: DataFrame) -> DataFrame:
    """(site, skipped): columns between a match column and the one before."""
    return matches.select(SITE, (F.col(SITE) - F.lag(SITE, 1, 0).over(Window.orderBy(SITE)) - 1).alias("skipped"))


def in_frequency_order(counts: DataFrame, columns=BASES) -> DataFrame:
    """Adds place: the rank of a row's counts, compared one after the other; there is a row for each column of the alignment."""
    return counts.withColumn("place", F.rank().over(Window.orderBy(*columns)))


def cumulative_counts(sites: DataFrame) -> DataFrame:
    """(base, n, before): how many symbols sort before a base."""
    sums = sites.groupBy(BASE).agg(F.count("*").alias("n"))
    return sums.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy(BASE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def states(sites: DataFrame, matches: DataFrame) -> DataFrame:
    """(id, site, base, state, profile): M, D on match columns, I elsewhere; other gaps have no state and are left out."""
    numbered = matches.select(SITE, F.row_number().over(Window.orderBy(SITE)).alias("k"))
    upto = sites.select(SITE).distinct().join(numbered, SITE, "left").select(SITE, F.col("k").isNotNull().alias("is_match"), F.coalesce(F.max("k").over(Window.orderBy(SITE).rowsBetween(Window.unboundedPreceding, 0)), F.lit(0)).alias("profile"))
    state = F.when(F.col("is_match"), F.when(F.col(BASE) == "-", "D").otherwise("M")).when(F.col(BASE) != "-", "I")
    return sites.join(F.broadcast(upto), SITE).withColumn("state", state).where(F.col("state").isNotNull()).select(ID, SITE, BASE, "state", "profile")


def state_counts(with_states: DataFrame) -> DataFrame:
    return with_states.where("state <> 'D'").groupBy("profile", "state", BASE).agg(F.count("*").alias("n"))


def transition_counts(with_states: DataFrame) -> DataFrame:
    """(profile, from_state, to_state, n): neighbours in a row after states that don't exist were left out; I to D and D to I are not counted."""
    following = F.lead("state").over(Window.partitionBy(ID).orderBy(SITE))
    pairs = with_states.select("profile", F.col("state").alias("from_state"), following.alias("to_state")).where("to_state is not null")
    return pairs.where(~((F.col("from_state") == "I") & (F.col("to_state") == "D")) & ~((F.col("from_state") == "D") & (F.col("to_state") == "I"))).groupBy("profile", "from_state", "to_state").agg(F.count("*").alias("n"))
