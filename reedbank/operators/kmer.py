"""K-mer index of an alignment: where each k-mer of the ungapped rows stands in the columns.

Lookups are equality joins on the k-mer, so the index is spread like any other table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbank.session import meet, spread


def index(msa: DataFrame, k: int, seq_id: str = "id", aligned: str = "aln") -> DataFrame:
    """(kmer, id, start, end, cs): every k-mer of every row with its 1-based closed columns and its stretch of the aligned row."""
    sites = F.transform(F.split(F.upper(F.col(aligned)), ""), lambda b, i: F.struct((i + 1).alias("c"), b.alias("b")))
    rows = spread(msa.select(seq_id, aligned)).select(F.col(seq_id).alias("id"), F.upper(F.col(aligned)).alias("aln"), F.filter(sites, lambda s: s["b"].isin("A", "C", "G", "T")).alias("s"))
    at = F.when(F.size("s") >= k, F.sequence(F.lit(1), F.size("s") - (k - 1)))
    kmers = rows.select("id", "aln", "s", F.explode(at).alias("i"))
    word = F.array_join(F.transform(F.slice("s", F.col("i"), F.lit(k)), lambda s: s["b"]), "")
    out = kmers.select(word.alias("kmer"), "id", F.element_at("s", F.col("i"))["c"].alias("start"), F.element_at("s", F.col("i") + (k - 1))["c"].alias("end"), "aln")
    return out.select("kmer", "id", "start", "end", F.substring("aln", F.col("start"), F.col("end") - F.col("start") + 1).alias("cs"))


def counts(kmers: DataFrame) -> DataFrame:
    return kmers.groupBy("kmer").agg(F.count("*").alias("n"))


def locate(kmers: DataFrame, patterns: DataFrame) -> DataFrame:
    """All places of each pattern (a column kmer)."""
    return meet(kmers, patterns.select("kmer").distinct(), "kmer")


def rows_with(kmers: DataFrame, patterns: DataFrame) -> DataFrame:
    """(kmer, ids): the rows that have each pattern, in order."""
    return locate(kmers, patterns).groupBy("kmer").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def first(kmers: DataFrame) -> DataFrame:
    """One place for each k-mer: smallest id, then smallest start."""
    return kmers.groupBy("kmer").agg(F.min(F.struct("id", "start", "end")).alias("x")).select("kmer", "x.id", "x.start", "x.end")


def seeds(reads: DataFrame, kmers: DataFrame, k: int, region: int, read: str = "read", seq: str = "seq") -> DataFrame:
    """(read, offset, id, start, end): a read's first k-mer within its first region bases that the index has, at its first place."""
    at = F.when(F.length(seq) >= k, F.sequence(F.lit(1), F.least(F.length(seq), F.lit(region)) - (k - 1)))
    own = reads.select(F.col(read).alias("read"), F.col(seq).alias("seq"), F.explode(at).alias("offset"))
    own = own.select("read", "offset", F.substring("seq", F.col("offset"), F.lit(k)).alias("kmer"))
    hits = meet(own, first(kmers), "kmer")
    return hits.groupBy("read").agg(F.min(F.struct("offset", "id", "start", "end")).alias("x")).select("read", "x.*")
