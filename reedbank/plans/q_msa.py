"""Queries of alignment profiles, hidden-state counts and the k-mer index."""

from pyspark.sql import functions as F

from reedbank.operators import kmer, msa, similarity
from reedbank.plans.fixtures import fx_aln, fx_read, fx_seq, table, with_
from reedbank.plans.registry import query

L, T = with_("fx_aln"), with_("fx_aln", "sites")
_N = "n AS (SELECT site, base, count(*) AS n FROM sites GROUP BY ALL)"
_F = "f AS (SELECT site, count(*) FILTER (base <> '-')::DOUBLE / count(*) AS symbol_fraction FROM sites GROUP BY site)"


def _sites(spark, d):
    return msa.long(fx_aln(spark, d))


@query(f"{L} SELECT count(*) AS n_seqs, max(length(aln)) AS n_columns, min(length(aln)) = max(length(aln)) AS is_aligned FROM fx_aln")
def msa_profile(spark, d):
    return msa.checked(fx_aln(spark, d))


@query(f"{T} SELECT site, base, count(*) AS n FROM sites GROUP BY ALL")
def column_counts(spark, d):
    return msa.column_counts(_sites(spark, d))


@query(f"{T} SELECT id, min(site) FILTER (base <> '-') AS first, max(site) FILTER (base <> '-') AS last, count(*) FILTER (base <> '-') AS n_bases FROM sites GROUP BY id")
def row_extent(spark, d):
    return msa.row_extent(fx_aln(spark, d))


_W = """b AS (SELECT * FROM sites WHERE base <> '-'), c AS (SELECT site, base, count(*) AS n, count(*) OVER (PARTITION BY site) AS kinds FROM b GROUP BY site, base),
r AS (SELECT id, sum(1.0::DOUBLE / (kinds * n)) / count(*) AS w FROM b JOIN c USING (site, base) GROUP BY id), w AS (SELECT id, w / sum(w) OVER () * count(*) OVER () AS weight FROM r)"""


@query(f"{T}, {_W} SELECT id, round(weight, 6) AS weight FROM w")
def seq_weights(spark, d):
    return msa.sequence_weights(_sites(spark, d)).withColumn("weight", F.round("weight", 6))


@query(f"{T}, {_W} SELECT site, base, round(sum(weight), 4) AS w FROM sites JOIN w USING (id) GROUP BY ALL")
def weighted_counts(spark, d):
    sites = _sites(spark, d)
    return msa.weighted_counts(sites, msa.sequence_weights(sites)).withColumn("w", F.round("w", 4))


_CS = "CASE WHEN g > greatest(a, c, t, k) THEN '-' WHEN a = greatest(a, c, t, k) THEN 'A' WHEN c = greatest(a, c, t, k) THEN 'C' WHEN k = greatest(a, c, t, k) THEN 'G' ELSE 'T' END"


@query(f"{T}, x AS (SELECT site, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS k, count(*) FILTER (base = 'T') AS t, count(*) FILTER (base = '-') AS g FROM sites GROUP BY site) SELECT site, {_CS} AS consensus FROM x")
def msa_consensus(spark, d):
    return msa.consensus(msa.column_counts(_sites(spark, d)))


@query(f"{T}, n AS (SELECT site, base, count(*) AS n FROM sites GROUP BY ALL) SELECT site, round(max(n) FILTER (base <> '-')::DOUBLE / sum(n), 9) AS identity, round(coalesce(sum(n) FILTER (base = '-'), 0)::DOUBLE / sum(n), 9) AS gap_fraction, round(1 - coalesce(sum(n) FILTER (base = '-'), 0)::DOUBLE / sum(n), 9) AS symbol_fraction FROM n GROUP BY site")
def column_fractions(spark, d):
    out = msa.column_fractions(_sites(spark, d))
    return out.select("site", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query(f"{T}, {_W}, x AS (SELECT site, base, sum(weight) AS w FROM sites JOIN w USING (id) GROUP BY ALL) SELECT site, round(max(w) FILTER (base <> '-') / sum(w), 6) AS identity, round(coalesce(sum(w) FILTER (base = '-'), 0) / sum(w), 6) AS gap_fraction, round(1 - coalesce(sum(w) FILTER (base = '-'), 0) / sum(w), 6) AS symbol_fraction FROM x GROUP BY site")
def weighted_fractions(spark, d):
    sites = _sites(spark, d)
    out = msa.weighted_fractions(msa.weighted_counts(sites, msa.sequence_weights(sites)))
    return out.select("site", *[F.round(c, 6).alias(c) for c in out.columns[1:]])


@query(f"{T} SELECT base, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS frequency FROM sites WHERE base <> '-' GROUP BY base")
def base_freq(spark, d):
    return msa.base_frequencies(_sites(spark, d)).withColumn("frequency", F.round("frequency", 9))


@query(f"{T}, {_F} SELECT site, round(symbol_fraction, 9) AS symbol_fraction FROM f WHERE symbol_fraction >= 0.875")
def match_columns(spark, d):
    return msa.match_columns(_sites(spark, d), 0.875).withColumn("symbol_fraction", F.round("symbol_fraction", 9))


@query(f"""{T}, p AS (SELECT id, site, CASE WHEN site % 5 = 0 THEN '-' ELSE base END AS base FROM sites), k AS (SELECT site, row_number() OVER (ORDER BY site) AS new_site FROM p GROUP BY site HAVING count(*) FILTER (base <> '-') > 0)
SELECT new_site, base, count(*) AS n FROM p JOIN k USING (site) GROUP BY ALL""")
def msa_prune(spark, d):
    sites = _sites(spark, d).withColumn("base", F.when(F.col("site") % 5 == 0, "-").otherwise(F.col("base")))
    return msa.prune(sites).groupBy("new_site", "base").agg(F.count("*").alias("n"))


@query(f"{T}, {_F} SELECT site, (symbol_fraction >= 0.875)::INT AS is_match, sum((symbol_fraction >= 0.875)::INT) OVER (ORDER BY site)::BIGINT AS profile FROM f")
def profile_index_running(spark, d):
    return msa.profile_index(msa.column_fractions(_sites(spark, d)), 0.875)


@query(f"{T}, {_F} SELECT site, site - lag(site, 1, 0) OVER (ORDER BY site) - 1 AS skipped FROM f WHERE symbol_fraction >= 0.875")
def map_gap_lag(spark, d):
    return msa.map_gaps(msa.match_columns(_sites(spark, d), 0.875))


@query(f"{T}, x AS (SELECT site, count(*) FILTER (base = 'A') AS a, count(*) FILTER (base = 'C') AS c, count(*) FILTER (base = 'G') AS g, count(*) FILTER (base = 'T') AS t FROM sites GROUP BY site) SELECT site, rank() OVER (ORDER BY a, c, g, t) AS place FROM x")
def frequency_order(spark, d):
    counts = _sites(spark, d).where("base <> '-'").groupBy("site").pivot("base", list(msa.BASES)).count().na.fill(0)
    return msa.in_frequency_order(counts).select("site", F.col("place").cast("long").alias("place"))


@query(f"{T}, c AS (SELECT base, count(*) AS n FROM sites GROUP BY base) SELECT base, n, coalesce(sum(n) OVER (ORDER BY base ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM c")
def cumulative_counts(spark, d):
    return msa.cumulative_counts(_sites(spark, d))


_ST = f"""{_F}, m AS (SELECT site, row_number() OVER (ORDER BY site) AS k FROM f WHERE symbol_fraction >= 0.875), u AS (SELECT f.site, m.k IS NOT NULL AS is_match, coalesce(max(m.k) OVER (ORDER BY f.site ROWS UNBOUNDED PRECEDING), 0) AS profile FROM f LEFT JOIN m ON m.site = f.site),
st AS (SELECT id, site, base, profile, CASE WHEN is_match THEN CASE WHEN base = '-' THEN 'D' ELSE 'M' END WHEN base <> '-' THEN 'I' END AS state FROM sites JOIN u USING (site)), s AS (SELECT * FROM st WHERE state IS NOT NULL)"""


def _states(spark, d):
    sites = _sites(spark, d)
    return msa.states(sites, msa.match_columns(sites, 0.875))


@query(f"{T}, {_ST} SELECT profile, state, base, count(*) AS n FROM s WHERE state <> 'D' GROUP BY ALL")
def hmm_state_counts(spark, d):
    return msa.state_counts(_states(spark, d))


@query(f"{T}, {_ST}, p AS (SELECT profile, state AS from_state, lead(state) OVER (PARTITION BY id ORDER BY site) AS to_state FROM s) SELECT profile, from_state, to_state, count(*) AS n FROM p WHERE to_state IS NOT NULL AND from_state || to_state NOT IN ('ID', 'DI') GROUP BY ALL")
def hmm_transition_counts(spark, d):
    return msa.transition_counts(_states(spark, d))


K = 8
_KM = f"""u AS (SELECT id, aln, list_filter(range(1, length(aln) + 1), lambda i: substr(aln, i::INT, 1) <> '-') AS c, regexp_replace(aln, '-', '', 'g') AS s FROM fx_aln),
k AS (SELECT substr(s, i::INT, {K}) AS kmer, id, c[i]::INT AS "start", c[i + {K - 1}]::INT AS "end", substr(aln, c[i]::INT, (c[i + {K - 1}] - c[i] + 1)::INT) AS cs FROM u, LATERAL (SELECT unnest(range(1, length(s) - {K - 2})) AS i))"""
_RD = with_("fx_aln", "fx_read")


def _index(spark, d):
    return kmer.index(fx_aln(spark, d), K)


@query(f"{L}, {_KM} SELECT * FROM k")
def kmer_index(spark, d):
    return _index(spark, d)


@query(f"{L}, {_KM} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def kmer_count(spark, d):
    return kmer.counts(_index(spark, d))


_PATTERNS = f"q AS (SELECT DISTINCT substr(seq, 3, {K}) AS kmer FROM fx_read)"


@query(f'{_RD}, {_KM}, {_PATTERNS} SELECT kmer, id, "start", "end", cs FROM k JOIN q USING (kmer)')
def kmer_locate(spark, d):
    return kmer.locate(_index(spark, d), fx_read(spark, d).select(F.substring("seq", 3, K).alias("kmer")))


@query(f"{_RD}, {_KM}, {_PATTERNS} SELECT kmer, array_to_string(list_sort(list_distinct(list(id))), ',') AS ids FROM k JOIN q USING (kmer) GROUP BY kmer")
def kmer_rows(spark, d):
    found = kmer.rows_with(_index(spark, d), fx_read(spark, d).select(F.substring("seq", 3, K).alias("kmer")))
    return found.select("kmer", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f'{L}, {_KM} SELECT kmer, id, "start", "end" FROM k QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY id, "start") = 1')
def kmer_first(spark, d):
    return kmer.first(_index(spark, d))


@query(f"""{_RD}, {_KM}, f AS (SELECT kmer, id, "start", "end" FROM k QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY id, "start") = 1), o AS (SELECT read, i::INT AS "offset", substr(seq, i::INT, {K}) AS kmer FROM fx_read, LATERAL (SELECT unnest(range(1, least(length(seq), 24) - {K - 2})) AS i))
SELECT read, "offset", id, "start", "end" FROM o JOIN f USING (kmer) QUALIFY row_number() OVER (PARTITION BY read ORDER BY "offset", id, "start") = 1""")
def kmer_seed_join(spark, d):
    return kmer.seeds(fx_read(spark, d), _index(spark, d), K, 24)


_DIST = "list_filter(range(1, 33), lambda i: substr(r.seq, i::INT, 1) <> substr(n.aln, i::INT, 1) AND substr(n.aln, i::INT, 1) <> '-')"


@query(f"""{_RD}, p AS (SELECT r.read, n.id AS node, len({_DIST})::DOUBLE / nullif(length(replace(n.aln, '-', '')), 0) AS dist FROM fx_read r CROSS JOIN fx_aln n)
SELECT read, node, round(dist, 9) AS dist FROM p WHERE dist IS NOT NULL QUALIFY row_number() OVER (PARTITION BY read ORDER BY dist, node) <= 5""")
def seed_topk(spark, d):
    return similarity.nearest_nodes(fx_read(spark, d), fx_aln(spark, d), 5, 32, node_seq="aln").withColumn("dist", F.round("dist", 9))


#: A primer for each region: ten bases with a degenerate one.
_PRIMER = "translate(substr(md5(r_name), 1, 10), '0123456789abcdef', 'ACGTACGTACGTRYNN')"


def _primers(spark, d):
    seq = F.translate(F.substring(F.md5(F.col("r_name").cast("binary")), 1, 10), "0123456789abcdef", "ACGTACGTACGTRYNN")
    return table(spark, d, "region").select(F.col("r_name").alias("primer"), seq.alias("seq"), (F.col("r_regionkey") * 4 + 1).alias("start"))


def _primer_nodes(spark, d):
    nodes = fx_aln(spark, d)
    inner = nodes.select(F.floor(F.col("id") / 2).alias("id")).distinct().withColumn("inner", F.lit(True))
    return nodes.join(inner, "id", "left").select("id", "aln", F.col("inner").isNull().alias("is_leaf"))


_MATCH = """CASE substr(seq, i::INT, 1) WHEN 'R' THEN 'AG' WHEN 'Y' THEN 'CT' WHEN 'N' THEN 'ACGT' ELSE substr(seq, i::INT, 1) END"""


@query(f"""{L}, pr AS (SELECT r_name AS primer, {_PRIMER} AS seq, r_regionkey * 4 + 1 AS st FROM region), nd AS (SELECT id, aln, id NOT IN (SELECT id // 2 FROM fx_aln) AS is_leaf FROM fx_aln),
h AS (SELECT primer, is_leaf, len(list_filter(range(1, 11), lambda i: NOT contains({_MATCH}, substr(aln, (st + i - 1)::INT, 1)))) <= 5 AS hit FROM nd CROSS JOIN pr)
SELECT primer, count(*) AS total_nodes, count(*) FILTER (is_leaf) AS total_leaves, count(*) FILTER (hit) AS hit_nodes, count(*) FILTER (hit AND is_leaf) AS hit_leaves, round(count(*) FILTER (hit)::DOUBLE / count(*), 9) AS efficiency_nodes, round(count(*) FILTER (hit AND is_leaf)::DOUBLE / count(*) FILTER (is_leaf), 9) AS efficiency_leaves FROM h GROUP BY primer""")
def primer_efficiency(spark, d):
    out = similarity.primer_hits(_primers(spark, d), _primer_nodes(spark, d), 0.5)
    return out.withColumn("efficiency_nodes", F.round("efficiency_nodes", 9)).withColumn("efficiency_leaves", F.round("efficiency_leaves", 9))


@query(f"""{L}, pr AS (SELECT r_name AS primer, {_PRIMER} AS seq, r_regionkey * 4 + 1 AS st FROM region)
SELECT primer, id, len(list_filter(range(1, 11), lambda i: NOT contains({_MATCH}, substr(aln, (st + i - 1)::INT, 1)))) / 10.0::DOUBLE AS dist FROM fx_aln CROSS JOIN pr""")
def primer_pdist(spark, d):
    from reedbank.functions.sequence import degenerate_match

    pairs = fx_aln(spark, d).crossJoin(F.broadcast(_primers(spark, d)))
    both = F.arrays_zip(F.split(F.substring("aln", F.col("start"), F.length("seq")), "").alias("a"), F.split(F.col("seq"), "").alias("b"))
    return pairs.select("primer", "id", (F.size(F.filter(both, lambda x: ~degenerate_match(x["a"], x["b"]))) / F.length("seq")).alias("dist"))


@query(f"{with_('fx_seq')} SELECT seq, count(*) AS n_reads, min(id) AS first_id FROM fx_seq GROUP BY seq")
def distinct_reads(spark, d):
    from reedbank.operators.reads import distinct_sequences

    return distinct_sequences(fx_seq(spark, d))
