"""Queries that run the engine's kernels over the driver's tables: likelihoods of cherries, training sets, posterior consensus, seeds, annotation, profiles."""

import numpy as np
from pyspark.sql import functions as F

from reedbank.functions.alphabet import DNA
from reedbank.operators import assignment, msa, otu, similarity, substitution, tree
from reedbank.plans import q_msa
from reedbank.plans.fixtures import fx_aln, fx_node, fx_read, table, with_
from reedbank.plans.q_otu import _READS, _SITE, _aligned_reads
from reedbank.plans.registry import query
from reedbank.session import meet

N, R, A = with_("fx_node"), with_("fx_node", recursive=True), with_("fx_node", "fx_aln")
_I = "LATERAL (SELECT unnest(range(1, 33))::INT AS i)"
_LEAF = "id NOT IN (SELECT parent FROM fx_node WHERE parent IS NOT NULL)"
_SIB = "sb AS (SELECT parent, min(id) AS a, max(id) AS b FROM fx_node WHERE parent IS NOT NULL GROUP BY parent HAVING count(*) >= 2)"


def codes_of(texts: list[str]) -> list[np.ndarray]:
    return [np.maximum(DNA.table()[np.frombuffer(t.encode(), np.uint8)], -1).astype(np.int8) for t in texts]


def _cherries(spark, d):
    """(parent, seq_a, seq_b, la, lb): pairs of children with their rows and branch lengths, never equal ones."""
    nodes = fx_node(spark, d)
    pairs = substitution.sibling_sequences(tree.sibling_pairs(nodes), fx_aln(spark, d), seq="aln")
    of = lambda c, more: nodes.select(F.col("id").alias(c), (F.col("length") + more).alias(f"l{c}"))
    return pairs.join(of("a", 0.0), "a").join(of("b", 0.001), "b").select("parent", "seq_a", "seq_b", "la", "lb")


@query(f"""{A}, {_SIB}, p AS (SELECT sb.parent, i, substr(x.aln, i, 1) AS ca, substr(y.aln, i, 1) AS cb, exp(-4.0::DOUBLE / 3 * m.length) AS ea, exp(-4.0::DOUBLE / 3 * (n.length + 0.001::DOUBLE)) AS eb
  FROM sb JOIN fx_aln x ON x.id = a JOIN fx_aln y ON y.id = b JOIN fx_node m ON m.id = a JOIN fx_node n ON n.id = b, {_I}),
q AS (SELECT parent, i, ca, cb, 0.25::DOUBLE + 0.75::DOUBLE * ea AS sa, 0.25::DOUBLE - 0.25::DOUBLE * ea AS da, 0.25::DOUBLE + 0.75::DOUBLE * eb AS sb, 0.25::DOUBLE - 0.25::DOUBLE * eb AS db FROM p)
SELECT parent, round(sum(ln(CASE WHEN ca = '-' OR cb = '-' THEN 0.0625::DOUBLE WHEN ca = cb THEN 0.25::DOUBLE * (sa * sb + 3 * da * db) ELSE 0.25::DOUBLE * (sa * db + da * sb + 2 * da * db) END)), 5) AS loglik,
  string_agg(CASE WHEN ca = '-' AND cb = '-' THEN '?' WHEN ca = '-' THEN cb WHEN cb = '-' OR ca = cb OR sa * db > da * sb THEN ca ELSE cb END, '' ORDER BY i) AS states,
  round(count(*) FILTER (CASE ca WHEN '-' THEN 'A' ELSE ca END <> CASE cb WHEN '-' THEN 'A' ELSE cb END) / 32.0::DOUBLE, 9) AS mismatch FROM q GROUP BY parent""")
def cherry_likelihood(spark, d):
    """Log-likelihood, most likely states at the parent, and the estimate of the branch between two leaves, under Jukes and Cantor's model."""
    from reedbank.kernels import likelihood, models

    def run(batches):
        import pyarrow as pa

        model = models.jc69()
        for batch in batches:
            out = []
            for a, b, la, lb in zip(*map(codes_of, (batch.column(1).to_pylist(), batch.column(2).to_pylist())), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                leaf = [likelihood.leaf_message(x, model) for x in (a, b)]
                up = likelihood.convolve(leaf, [la, lb], model)
                states = np.where((a < 0) & (b < 0), 4, likelihood.infer_states(up))
                out.append((likelihood.tree_loglik(up, model), "".join("ACGT?"[s] for s in states), likelihood.mismatch_length(*leaf)))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([r[i] for r in out], t) for i, t in enumerate((pa.float64(), pa.string(), pa.float64()))]], names=["parent", "loglik", "states", "mismatch"])

    out = _cherries(spark, d).mapInArrow(run, "parent bigint, loglik double, states string, mismatch double")
    return out.select("parent", F.round("loglik", 5).alias("loglik"), "states", F.round("mismatch", 9).alias("mismatch"))


@query(f"""{A}, tip AS (SELECT parent AS id FROM fx_node WHERE parent IS NOT NULL GROUP BY parent HAVING bool_and({_LEAF})), {_SIB},
p AS (SELECT sb.parent, a, b, count(*) FILTER (substr(x.aln, i, 1) <> substr(y.aln, i, 1))::DOUBLE / count(*) AS dist FROM sb JOIN tip ON tip.id = sb.parent JOIN fx_aln x ON x.id = a JOIN fx_aln y ON y.id = b, {_I} WHERE substr(x.aln, i, 1) <> '-' AND substr(y.aln, i, 1) <> '-' GROUP BY ALL)
SELECT parent, a, b FROM p WHERE dist <= 0.7""")
def training_pairs(spark, d):
    """Pairs of close leaves that substitution models are trained from."""
    from reedbank.plans.build import training_pairs as found

    return found(fx_node(spark, d), fx_aln(spark, d), 0.7).select("parent", "a", "b")


_WEIGHT = {b: f"((otu * {m} + site * {k}) % 11) / 10.0::DOUBLE" for b, m, k in (("a", 7, 3), ("c", 3, 5), ("g", 5, 7), ("t", 2, 9))}


@query(f"""{with_('fx_aln')}, {_READS}, {_SITE}, p AS (SELECT otu, site, gap, a + c + g + t AS n, """ + ", ".join(f"{b} + CASE WHEN a + c + g + t >= gap THEN 2.0::DOUBLE * ({w}) ELSE 0.0::DOUBLE END AS p{b}" for b, w in _WEIGHT.items()) + """ FROM c)
SELECT otu, string_agg(CASE WHEN gap > n THEN '-' WHEN pa = greatest(pa, pc, pg, pt) THEN 'A' WHEN pc = greatest(pa, pc, pg, pt) THEN 'C' WHEN pg = greatest(pa, pc, pg, pt) THEN 'G' ELSE 'T' END, '' ORDER BY site) AS consensus FROM p GROUP BY otu""")
def posterior_consensus(spark, d):
    """Consensus with prior reads by how likely each base is at the OTU's node."""
    from reedbank.plans.summarise import posterior_consensus as found

    sites = otu.site_counts(_aligned_reads(spark, d), "otu", "aln")
    share = lambda m, k: ((F.col("otu") * m + F.col("site") * k) % 11) / F.lit(10.0)
    weights = sites.select("otu", "site", share(7, 3).alias("wa"), share(3, 5).alias("wc"), share(5, 7).alias("wg"), share(2, 9).alias("wt"))
    return found(sites, weights, 2.0)


_UP = f"up(start, node, distance) AS (SELECT id, id, 0.0::DOUBLE FROM fx_node WHERE {_LEAF} UNION ALL SELECT u.start, n.parent, u.distance + n.length FROM up u JOIN fx_node n ON n.id = u.node WHERE n.parent IS NOT NULL)"


@query(f"""{with_('fx_node', 'fx_aln', 'fx_read', recursive=True)}, {_UP}, h AS (SELECT node AS id, min(distance) AS height FROM up GROUP BY node),
p AS (SELECT r.read, n.id AS node, len({q_msa._DIST})::DOUBLE / nullif(length(replace(n.aln, '-', '')), 0) AS dist FROM fx_read r CROSS JOIN (SELECT * FROM fx_aln JOIN h USING (id) WHERE height <= 0.255) n)
SELECT read, node, round(dist, 9) AS dist FROM p WHERE dist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY read ORDER BY dist, node) <= 5""")
def seed_height(spark, d):
    """Nearest nodes among those that are no further from a leaf than a limit."""
    nodes = meet(fx_aln(spark, d), tree.heights(fx_node(spark, d)), "id")
    return similarity.nearest_nodes(fx_read(spark, d), nodes, 5, 32, node_seq="aln", max_height=0.255).withColumn("dist", F.round("dist", 9))


@query("""WITH f AS (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100) SELECT count(*) FILTER (l_discount < l_tax) AS n_forward, count(*) FILTER (l_discount > l_tax) AS n_reverse,
CASE WHEN count(*) FILTER (l_discount < l_tax) >= 0.6 * count(*) FILTER (l_discount <> l_tax) THEN 1 WHEN count(*) FILTER (l_discount > l_tax) >= 0.6 * count(*) FILTER (l_discount <> l_tax) THEN 2 ELSE 0 END AS strand FROM f""")
def strand_vote_first(spark, d):
    """The strand by the first 100 reads only, which is how many the vote takes."""
    first = table(spark, d, "lineitem").orderBy("l_orderkey", "l_linenumber").limit(100)
    return assignment.strand_vote(first.select(F.col("l_discount").alias("cost_fwd"), F.col("l_tax").alias("cost_rev")), share=0.6)


_NAMED = "nm AS (SELECT id, parent, length, CASE WHEN id % 10 = 1 THEN 'k__K;p__P' || id WHEN id % 3 = 0 THEN 'g__G' || id WHEN id % 7 = 0 THEN 'k__K;c__C' ELSE 'x' END AS name FROM fx_node)"


@query(f"""{R}, {_NAMED}, walk(start, node, dist, path) AS (SELECT id, id, 0.0::DOUBLE, []::VARCHAR[] FROM nm UNION ALL
  SELECT w.start, n.parent, w.dist + n.length, CASE WHEN n.name LIKE 'g__G%' OR n.name = 'k__K;c__C' THEN list_concat([n.name], w.path) ELSE w.path END FROM walk w JOIN nm n ON n.id = w.node WHERE n.id % 10 <> 1 AND n.parent IS NOT NULL)
SELECT start AS id, array_to_string(list_concat([n.name], path), ';') AS anno, round(dist, 9) AS anno_dist FROM walk JOIN nm n ON n.id = node WHERE n.id % 10 = 1""")
def annotate_full_path(spark, d):
    """Names from the nearest full path on the way up, and those that stand before it."""
    i = F.col("id")
    text = i.cast("string")
    name = F.when(i % 10 == 1, F.concat(F.lit("k__K;p__P"), text)).when(i % 3 == 0, F.concat(F.lit("g__G"), text)).when(i % 7 == 0, "k__K;c__C").otherwise("x")
    return tree.annotate_by_path(fx_node(spark, d).withColumn("name", name)).withColumn("anno_dist", F.round("anno_dist", 9))


@query(f"""{q_msa.T}, {q_msa._W}, x AS (SELECT site, base, sum(weight) AS w FROM sites JOIN w USING (id) GROUP BY ALL), f AS (SELECT site, sum(w) FILTER (base <> '-') / sum(w) AS share, sum(w) FILTER (base <> '-') AS n FROM x GROUP BY site),
m AS (SELECT site, n, row_number() OVER (ORDER BY site) AS profile FROM f WHERE share >= 0.87), bs AS (SELECT unnest(['A', 'C', 'G', 'T']) AS base)
SELECT profile, bs.base, round((coalesce(x.w, 0) + 0.5::DOUBLE) / (n + 2), 6) AS p FROM m CROSS JOIN bs LEFT JOIN x ON x.site = m.site AND x.base = bs.base""")
def hmm_emissions(spark, d):
    """Match emissions of the profile of an alignment, as posterior means under a flat prior."""
    from reedbank.kernels import hmm
    from reedbank.kernels.dirichlet import Prior
    from reedbank.plans.build import profile_counts

    made = hmm.estimate(profile_counts(fx_aln(spark, d), 0.87), Prior.flat())
    # a row for each position and base of one profile
    rows = [(k, b, float(made.em[k, i])) for k in range(1, made.size + 1) for i, b in enumerate(msa.BASES)]
    return spark.createDataFrame(rows, "profile bigint, base string, p double").withColumn("p", F.round("p", 6))


_K = q_msa.K


@query(f"""{q_msa._RD}, {q_msa._KM}, f AS (SELECT kmer, "start", "end" FROM k QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY id, "start") = 1),
o AS (SELECT seq AS text, i::INT - 1 AS pos, substr(seq, i::INT, {_K}) AS kmer FROM (SELECT DISTINCT seq FROM fx_read), LATERAL (SELECT unnest(range(1, length(seq) - {_K - 2})) AS i)),
h AS (SELECT text, pos, "start", "end" FROM o JOIN f USING (kmer)),
a AS (SELECT text, pos, "start", "end" FROM h WHERE pos < 10 QUALIFY row_number() OVER (PARTITION BY text ORDER BY pos) = 1), z AS (SELECT text, pos, "start", "end" FROM h WHERE pos > 32 - {_K} - 10 QUALIFY row_number() OVER (PARTITION BY text ORDER BY pos DESC) = 1)
SELECT coalesce(a.text, z.text) AS text, a.pos AS first_at, a."start" AS first_start, a."end" AS first_end, z.pos AS last_at, z."start" AS last_start, z."end" AS last_end FROM a FULL JOIN z ON a.text = z.text""")
def outer_seeds(spark, d):
    """The first and the last k-mer of each read that the index has, which alignment bands are laid around."""
    from reedbank.operators import kmer
    from reedbank.plans.assign import joined_hits

    hits = joined_hits(fx_read(spark, d).select(F.col("seq").alias("text")).distinct(), kmer.index(fx_aln(spark, d), _K), _K, 10)
    return hits.select("text", *[F.col(f"{c}.{x}").alias(f"{c}_{x}") for c in ("first", "last") for x in ("at", "start", "end")])
