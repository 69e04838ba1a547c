"""Assignments of reads: filters, joins with taxa, branches and samples, strand votes and chimera splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbank.functions import taxon

ASSIGNMENT = (
    "id STRING, description STRING, seq_start INT, seq_end INT, hmm_start INT, hmm_end INT, CS_start INT, CS_end INT, cost DOUBLE, alignment STRING, "
    "branch_id STRING, branch_ratio DOUBLE, taxon_id LONG, taxon_anno STRING, anno_dist DOUBLE, loglik DOUBLE, Q_placement DOUBLE, Q_taxon DOUBLE"
)


def parse_lines(lines: DataFrame, line: str, schema: str, sep: str = "\t") -> DataFrame:
    """Rows of tab-separated text under an explicit schema; a malformed number fails instead of becoming 0."""
    return lines.select(F.from_csv(F.col(line), schema, {"sep": sep, "mode": "FAILFAST"}).alias("r")).select("r.*")


def filter_by_quality(assignments: DataFrame, min_q: float = 0, min_alignment: float = 0, min_profile: float = 0, taxon_id: str = "taxon_id", q: str = "q_taxon") -> DataFrame:
    """Assigned reads of enough quality; identities are only computed where they are asked for."""
    keep = (F.col(taxon_id) >= 0) & (F.col(q) >= min_q)
    if min_alignment:
        keep &= F.col("aln_identity") >= min_alignment
    if min_profile:
        keep &= F.col("hmm_identity") >= min_profile
    return assignments.where(keep)


def join_taxa(assignments: DataFrame, nodes: DataFrame, taxon_id: str = "taxon_id", node_id: str = "id") -> DataFrame:
    """Adds the node's columns; Spark broadcasts nodes where they are small enough and shuffles otherwise."""
    return assignments.join(nodes, assignments[taxon_id] == nodes[node_id])


def rename_samples(assignments: DataFrame, sample_list: DataFrame, file: str = "file") -> DataFrame:
    """Only files on the list stay, under the list's names."""
    return assignments.join(sample_list, file).drop(file)


def join_edges(assignments: DataFrame, edges: DataFrame, branch: str = "branch_id") -> DataFrame:
    """Adds the branch's length and edge id (the child, -1 if the two nodes aren't neighbours)."""
    child, parent = taxon.parse_branch_id(F.col(branch))
    own = assignments.withColumn("child", child).withColumn("parent", parent)
    found = own.join(edges.select(F.col("u").alias("child"), F.col("v").alias("parent"), "length"), ["child", "parent"], "left")
    return found.withColumn("edge_id", F.when(F.col("length").isNull(), F.lit(-1)).otherwise(F.col("child")))


def in_order(forward: tuple[Column, Column], reverse: tuple[Column, Column]) -> Column:
    """Whether a forward read neither starts nor ends behind its mate."""
    return (forward[0] <= reverse[0]) & (forward[1] <= reverse[1])


def is_chimera(taxon5: Column, taxon3: Column, lod: Column, min_lod: float = 0) -> Column:
    return ~taxon5.eqNullSafe(taxon3) & (lod > min_lod)


def strand_vote(costs: DataFrame, forward: str = "cost_fwd", reverse: str = "cost_rev", share: float = 0.9) -> DataFrame:
    """One row: reads that align better as they are and as reverse complement, and the strand (1, 2) that has the share, else 0."""
    sums = costs.agg(F.count_if(F.col(forward) < F.col(reverse)).alias("n_forward"), F.count_if(F.col(forward) > F.col(reverse)).alias("n_reverse"))
    all_ = F.col("n_forward") + F.col("n_reverse")
    return sums.withColumn("strand", F.when(F.col("n_forward") >= share * all_, 1).when(F.col("n_reverse") >= share * all_, 2).otherwise(0))


def zip_pairs(forward: DataFrame, reverse: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Mates by their place in the two files; ids are not compared, and the longer file's rest is left out."""
    return forward.join(reverse, ordinal)


def is_valid_alignment(start: Column, end: Column, seq_start: Column, seq_end: Column, alignment: Column) -> Column:
    return (start >= 1) & (start <= end) & (seq_start <= seq_end) & (F.length(alignment) > 0)


def jplace_columns(ratio: Column, length: Column, anno_dist: Column, q: Column) -> dict[str, Column]:
    """Columns of a jplace row: the weight is the posterior, 1 - 10^(-q/10)."""
    distal, proximal = length * ratio, length * (1 - ratio)
    return {"distal_length": distal, "proximal_length": proximal, "pendant_length": anno_dist - F.when(ratio <= 0.5, distal).otherwise(proximal), "like_weight_ratio": 1 - F.pow(F.lit(10.0), -q / 10)}
