"""Summarise assignments into OTU tables, read lists, consensus sequences and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbank.functions.sequence import alignment_identity, profile_identity
from reedbank.operators import contraction, otu, tree
from reedbank.operators.assignment import filter_by_quality


def filtered(assignments: DataFrame, min_q: float = 0, min_identity: float = 0, min_profile: float = 0, columns=None) -> DataFrame:
    """Assignments of enough quality; columns: the profile's alignment columns, needed with min_profile.  Identities that aren't asked for aren't computed."""
    where = (F.col("CS_start"), F.col("CS_end"))
    if min_identity:
        assignments = assignments.withColumn("aln_identity", alignment_identity(F.col("alignment"), *where))
    if min_profile:
        assignments = assignments.withColumn("hmm_identity", profile_identity(F.col("alignment"), F.lit([int(c) for c in columns]), *where))
    return filter_by_quality(assignments, min_q, min_identity, min_profile, q="Q_taxon")


def otu_table(assignments: DataFrame, nodes: DataFrame, min_reads: int = 0, min_samples: int = 0) -> DataFrame:
    """(otu, taxonomy, sample, n) of supported OTUs; assignments need a column sample."""
    counts = otu.count_otus(assignments)
    kept = counts.join(otu.supported(counts, min_reads, min_samples).select("otu"), "otu", "left_semi") if min_reads or min_samples else counts
    return kept.join(nodes.select(F.col("id").alias("otu"), F.col("anno").alias("taxonomy")), "otu").select("otu", "taxonomy", "sample", "n")


def node_weights(db, otus: DataFrame) -> DataFrame:
    """(otu, site, wa, wc, wg, wt): by column how likely each base is at the tree's nodes otus, given all leaves."""
    weights = contraction.weights_of(db.node.select("id", "parent", "length"), db.node.where("is_leaf").select("id", "seq"), db.model, db.rates)
    return weights.withColumnRenamed("id", "otu").join(otus.select("otu").distinct(), "otu", "left_semi")


def consensus(assignments: DataFrame, db, weight: float = 2.0) -> DataFrame:
    """(otu, consensus): by column the base with most counts plus weight times its posterior at the OTU's node; a gap where gaps outnumber bases."""
    return posterior_consensus(otu.site_counts(assignments, "taxon_id", "alignment"), node_weights(db, assignments.select(F.col("taxon_id").alias("otu"))), weight)


def posterior_consensus(sites: DataFrame, weights: DataFrame, weight: float = 2.0) -> DataFrame:
    """(otu, consensus) of site_counts with (otu, site, wa, wc, wg, wt) as prior reads."""
    joined = sites.join(weights, ["otu", "site"], "left")
    total = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    for base in "acgt":
        joined = joined.withColumn(f"p{base}", F.col(base) + F.when(total >= F.col("gap"), weight * F.coalesce(f"w{base}", F.lit(0.0))).otherwise(0.0))
    best = F.greatest("pa", "pc", "pg", "pt")
    letter = F.when(F.col("gap") > total, F.lit("-"))
    for base in "acgt":
        letter = letter.when(F.col(f"p{base}") == best, F.lit(base.upper()))
    rows = joined.select("otu", F.struct("site", letter.alias("b")).alias("x"))
    return rows.groupBy("otu").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("consensus"))


def otu_descriptions(table: DataFrame, nodes: DataFrame, database: str) -> DataFrame:
    """(otu, description) of an OTU table: database, taxonomy, distance to the annotated node, reads and samples."""
    sums = table.groupBy("otu", "taxonomy").agg(F.sum("n").alias("reads"), F.count_if(F.col("n") > 0).alias("samples"))
    far = nodes.select(F.col("id").alias("otu"), "anno_dist")
    text = F.format_string('DBName=%s;Taxonomy="%s";AnnoDist=%s;ReadCount=%d;SampleHits=%d', F.lit(database), F.coalesce("taxonomy", F.lit("")), F.col("anno_dist").cast("string"), F.col("reads").cast("long"), F.col("samples"))
    return sums.join(far, "otu").select("otu", text.alias("description"))


def otu_tree(table: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes of the tree cut to the table's OTUs; numeric ids may have a prefix in front of their last part."""
    kept = table.select(F.regexp_extract(F.col("otu").cast("string"), r"(\d+)$", 1).cast("long").alias("id")).distinct()
    return tree.pruned(nodes.select("id", "parent", "length"), kept)


def with_pseudo_leaves(rows: list[tuple], otus: set[int]) -> list[tuple]:
    """Rows (id, parent, name, length) in which every inner OTU has a leaf of its own, at no distance, that has its name."""
    inner = {r[1] for r in rows if r[1] is not None}
    last = max((r[0] for r in rows), default=-1)
    out = list(rows)
    for r in rows:
        if r[0] in otus and r[0] in inner:
            last += 1
            out.append((last, r[0], r[2], 0.0))
    return out
