"""Build a database from an alignment, a tree and a taxonomy: counts and the k-mer index in Spark, models and messages on the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.kernels import hmm, models
from reedbank.kernels.dirichlet import Prior
from reedbank.kernels.likelihood import Tree, ancestral_sequences
from reedbank.operators import kmer, msa, substitution
from reedbank.session import stored
from reedbank.sources.database import Database, node_table
from reedbank.sources.newick import flatten
from reedbank.sources.newick import Tree as Newick

SEED_LENGTH = 20


def profile_counts(alignment: DataFrame, match_fraction: float = 0.5) -> hmm.Counts:
    """Weighted counts of a profile from (id, aln): group-bys over sites; what comes to the driver has a row for each column and state."""
    width = alignment.select(F.max(F.length("aln"))).first()[0]
    sites = msa.long(alignment)
    weights = stored(msa.sequence_weights(sites), "sequence_weights")
    weighted = msa.with_weights(sites, weights)
    share = weighted.groupBy("site").agg((F.sum(F.when(F.col("base") != "-", F.col("weight"))) / F.sum("weight")).alias("symbol_fraction"))
    matches = share.where(F.col("symbol_fraction") >= match_fraction)
    columns = np.array([0, *sorted(r.site for r in matches.collect())])
    k = len(columns) - 1
    states = msa.with_weights(msa.states(sites, matches), weights)
    em, ei, t = np.zeros((k + 1, 4)), np.zeros((k + 1, 4)), np.zeros((k + 1, 7))
    for r in states.where("state <> 'D'").groupBy("profile", "state", "base").agg(F.sum("weight").alias("w")).collect():
        (em if r.state == "M" else ei)[r.profile, "ACGT".index(r.base)] = r.w
    from pyspark.sql import Window

    by_row = Window.partitionBy("id").orderBy("site")
    following = states.select("profile", "weight", F.col("state").alias("a"), F.coalesce(F.lead("state").over(by_row), F.lit("M")).alias("b"), F.row_number().over(by_row).alias("i"), "state")
    begin = following.where("i = 1").select(F.lit(0).alias("profile"), "weight", F.lit("M").alias("a"), F.col("state").alias("b"))
    steps = following.select("profile", "weight", "a", "b").unionByName(begin)
    place = {"MM": hmm.MM, "MI": hmm.MI, "MD": hmm.MD, "IM": hmm.IM, "II": hmm.II, "DM": hmm.DM, "DD": hmm.DD}
    for r in steps.groupBy("profile", "a", "b").agg(F.sum("weight").alias("w")).collect():
        if r.a + r.b in place:
            t[r.profile, place[r.a + r.b]] += r.w
    n = weights.agg(F.sum("weight")).first()[0] or 0.0
    return hmm.Counts(em, ei, t, columns, width, float(n))


def training_pairs(nodes: DataFrame, sequences: DataFrame, most_distance: float = 0.15) -> DataFrame:
    """(seq_a, seq_b): first and last leaf of each tip (a node with leaves only) that are no further apart than most_distance."""
    from reedbank.functions.distance import p_distance
    from reedbank.operators.tree import sibling_pairs, tips

    pairs = sibling_pairs(nodes).join(tips(nodes).withColumnRenamed("id", "parent"), "parent")
    return substitution.sibling_sequences(pairs, sequences, seq="aln").where(p_distance(F.col("seq_a"), F.col("seq_b")) <= most_distance)


def training_triplets(nodes: DataFrame, sequences: DataFrame, most_distance: float = 0.15, seed: int = 0) -> DataFrame:
    """(seq_o, seq_a, seq_b): for each node with two children of which one is a tip, the tip's first and last leaf and a leaf below the other child, where both
    are no further from it than most_distance."""
    from reedbank.functions.distance import p_distance
    from reedbank.operators.tree import children, first_last_child, random_leaf, tips

    tip = tips(nodes).select(F.col("id").alias("child"), F.lit(True).alias("is_tip"))
    kids = children(nodes).join(tip, "child", "left").withColumn("is_tip", F.coalesce("is_tip", F.lit(False)))
    # of two tips the first is the inner one
    both = kids.groupBy("parent").agg(F.array_sort(F.collect_list(F.struct((~F.col("is_tip")).alias("outer"), "child"))).alias("c")).where((F.size("c") == 2) & ~F.col("c")[0]["outer"])
    pairs = both.select(F.col("c")[0]["child"].alias("tip"), F.col("c")[1]["child"].alias("id")).join(random_leaf(nodes, seed), "id")
    inner = first_last_child(nodes).select(F.col("parent").alias("tip"), F.col("first_child").alias("a"), F.col("last_child").alias("b"))
    found = substitution.sibling_sequences(pairs.join(inner, "tip"), sequences, seq="aln")
    found = found.join(sequences.select(F.col("id").alias("leaf"), F.col("aln").alias("seq_o")), "leaf")
    near = lambda x: p_distance(F.col("seq_o"), F.col(x)) <= most_distance
    return found.where(near("seq_a") & near("seq_b"))


def train_substitution(kind: str, nodes: DataFrame, sequences: DataFrame, most_distance: float = 0.15, method: str = "pairs") -> models.Model:
    """From paired bases of leaves of tips (method pairs), or from bases of a tip's leaves and an outer one and what their ancestor had (triplets)."""
    if method == "pairs":
        found = substitution.transitions_of_pairs(substitution.pair_sites(training_pairs(nodes, sequences, most_distance), "seq_a", "seq_b"))
    elif method == "triplets":
        found = substitution.transitions_of_triplets(substitution.pair_sites(training_triplets(nodes, sequences, most_distance), "seq_o", "seq_a", "seq_b"), outer=True)
    else:
        raise ValueError(f"unknown method {method!r}")
    counts = np.zeros((4, 4))
    for r in found.collect():
        counts["ACGT".index(r.from_base), "ACGT".index(r.to_base)] = r.n
    pi = np.array([{r.base: r.n for r in msa.base_frequencies(msa.long(sequences)).collect()}.get(b, 0) for b in "ACGT"], float)
    # a pair that never changed would make a rate of zero
    return models.train(kind, counts + 0.5 + np.eye(4), (pi + 1) / (pi + 1).sum())


def train_prior(spark: SparkSession, counts: hmm.Counts, components: int = 5, seeds: int = 1, prior_rate: float = 0.05) -> Prior:
    """Priors from a profile's counts, whose total weight is scaled to 1 / prior_rate rows, so that a prior of one row weighs about prior_rate.  The starts of
    the mixture run in parallel; the best one stays."""
    from reedbank.kernels.dirichlet import train

    scale = 1 / (prior_rate * max(counts.n, 1e-300))
    em, ei, t = counts.em[1:] * scale, counts.ei * scale, counts.t * scale
    shared = spark.sparkContext.broadcast(em)

    def run(batches):
        import pickle

        import pyarrow as pa

        for batch in batches:
            for seed in batch.column(0).to_pylist():
                made = train(shared.value, components, seed)
                yield pa.RecordBatch.from_arrays([pa.array([float(made.cost)]), pa.array([seed]), pa.array([pickle.dumps((made.q, made.alpha, made.cost))], pa.binary())], names=["cost", "seed", "model"])

    best = spark.range(0, seeds, 1, seeds).mapInArrow(run, "cost double, seed bigint, model binary").orderBy("cost", "seed").first()
    import pickle

    from reedbank.kernels.dirichlet import Mixture

    some = lambda x, fallback: train(x) if (x.sum(1) > 0).any() else fallback
    flat = Prior.flat()
    return Prior(Mixture(*pickle.loads(best.model)), some(ei, flat.insert), some(t[:, :3], flat.from_match), some(t[:, 3:5], flat.from_insert), some(t[:, 5:], flat.from_delete))


#: Columns whose messages a task holds at a time.
SITES = 64


def ancestral_by_sites(spark: SparkSession, tree: Tree, model: models.Model, rates=None, sites: int = SITES) -> np.ndarray:
    """Codes of all nodes, by tasks over stretches of columns: messages take nodes x columns x 4 numbers, which no single process needs to hold."""
    width = tree.codes.shape[1]
    shared = spark.sparkContext.broadcast((tree.parent, tree.length, tree.codes, model, rates))

    def run(batches):
        import pyarrow as pa

        parent, length, codes, model, rates = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                part = ancestral_sequences(Tree(parent, length, codes[:, i * sites : (i + 1) * sites]), model, rates)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([part.tobytes()], pa.binary())], names=["i", "codes"])

    n = -(-width // sites)
    out = np.empty_like(tree.codes)
    for r in spark.range(0, n, 1, n).mapInArrow(run, "i bigint, codes binary").toLocalIterator():
        part = np.frombuffer(r.codes, np.int8).reshape(len(out), -1)
        out[:, r.i * sites : r.i * sites + part.shape[1]] = part
    return out


def annotate(spark: SparkSession, tree_rows: list[tuple], taxonomy: dict[str, str], root_name: str = "") -> tuple[list[str], list[float]]:
    """(annotation, distance to the node that has it) of every node, by tree.annotate_by_path; names are the taxonomy's where it has them."""
    from reedbank.operators.tree import annotate_by_path

    named = [(r[0], r[1], taxonomy.get(r[2] or "", r[2] or ""), float(r[3] or 0.0)) for r in tree_rows]
    found = {r.id: r for r in annotate_by_path(spark.createDataFrame(named, "id LONG, parent LONG, name STRING, length DOUBLE"), root_name).toLocalIterator()}
    return [found[r[0]].anno for r in tree_rows], [found[r[0]].anno_dist for r in tree_rows]


def build(spark: SparkSession, alignment: DataFrame, newick: Newick, taxonomy: dict[str, str] | None = None, prior: Prior | None = None, model: models.Model | str = "GTR", gamma: int = 0, match_fraction: float = 0.5, seed_length: int = SEED_LENGTH) -> Database:
    """alignment: (id, name, aln), all of one width, with a row for every leaf of the tree."""
    shape = msa.checked(alignment).first()
    if not shape.is_aligned:
        raise ValueError("the alignment's rows differ in length")
    rows = flatten(newick)
    aligned = {r.name: r.aln.upper() for r in alignment.select("name", "aln").toLocalIterator()}
    missing = [r[2] for r in rows if r[4] and r[2] not in aligned]
    if missing:
        raise ValueError(f"{len(missing)} leaves have no aligned sequence, {missing[0]!r} for one")
    width = shape.n_columns
    codes = np.full((len(rows), width), -1, np.int8)
    for r in rows:
        if r[4]:
            codes[r[0]] = ["ACGT".find(c) for c in aligned[r[2]]]
    lengths = np.array([max(r[3] or 0.0, 1e-5) if r[4] else max(r[3] or 0.0, 0.0) for r in rows])
    tree = Tree(np.array([-1 if r[1] is None else r[1] for r in rows]), lengths, codes)
    if isinstance(model, str):
        nodes = spark.createDataFrame([(r[0], r[1]) for r in rows], "id LONG, parent LONG")
        sequences = spark.createDataFrame([(r[0], aligned[r[2]]) for r in rows if r[4]], "id LONG, aln STRING")
        model = train_substitution(model, nodes, sequences)
    profile = hmm.build(profile_counts(alignment.select("id", "aln"), match_fraction), prior or Prior.flat())
    sequences = ancestral_by_sites(spark, tree, model)
    rates = None
    if gamma:
        inner = [u for u in tree.preorder if tree.parent[u] >= 0]
        changed = np.array([sequences[u] != sequences[tree.parent[u]] for u in inner]) & np.array([(sequences[u] >= 0) & (sequences[tree.parent[u]] >= 0) for u in inner])
        rates = models.gamma_rates(gamma, models.gamma_shape(changed.sum(0)))
        sequences = ancestral_by_sites(spark, tree, model, rates)
    annos, dists = annotate(spark, rows, taxonomy or {})
    node = node_table(spark, tree, [r[2] for r in rows], annos, dists, sequences)
    return Database(alignment, node, kmer.index(alignment.select("id", "aln"), seed_length), profile, model, rates)
