"""Queries of OTU table algebra."""

from pyspark.sql import functions as F

from reedbank.operators import assignment, otu
from reedbank.plans.fixtures import dna, fx_assign, fx_otu, table, with_
from reedbank.plans.registry import query

W = with_("fx_otu")
DEPTH = 20


def _n(df, *names):
    return df.select(*[F.col(c).cast("long").alias(c) if c in ("n", "total") else F.col(c) for c in (names or df.columns)])


@query(f"{with_('fx_assign')} SELECT taxon_id AS otu, p_type AS taxonomy, sample, count(*) AS n FROM fx_assign JOIN part ON p_partkey + 1 = taxon_id WHERE taxon_id >= 0 AND q_taxon >= 30 GROUP BY ALL")
def otu_count(spark, d):
    taxa = table(spark, d, "part").select((F.col("p_partkey") + 1).alias("id"), F.col("p_type").alias("taxonomy"))
    joined = assignment.join_taxa(assignment.filter_by_quality(fx_assign(spark, d), 30), taxa)
    return otu.count_otus(joined, keys=("taxonomy", "sample"))


@query(f"{W} SELECT otu, sum(n)::BIGINT AS reads, count(*) AS samples FROM fx_otu GROUP BY otu HAVING sum(n) >= 25 AND count(*) >= 20")
def otu_support_having(spark, d):
    return otu.supported(fx_otu(spark, d), 25, 20)


#: Samples are the suppliers' nations, whose numbers are known: so a wide table has all of them.
_NATIONS = range(25)
_BY_NATION = "c AS (SELECT l_partkey AS otu, s_nationkey AS sample, count(*) AS n FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL)"


def _by_nation(spark, d):
    joined = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("l_partkey").alias("otu"), F.col("s_nationkey").alias("sample")).agg(F.count("*").alias("n"))


@query(f"WITH {_BY_NATION} SELECT otu, " + ", ".join(f"coalesce(sum(n) FILTER (sample = {s}), 0)::DOUBLE AS s{s}" for s in _NATIONS) + " FROM c GROUP BY otu")
def otu_pivot(spark, d):
    return otu.pivot(_by_nation(spark, d), _NATIONS)


@query(f"WITH {_BY_NATION} SELECT otu, 's' || sample AS sample, n::DOUBLE AS n FROM c")
def otu_unpivot(spark, d):
    return otu.unpivot(otu.pivot(_by_nation(spark, d), _NATIONS))


@query(f"WITH {_BY_NATION} SELECT otu, sample, coalesce(n, 0)::BIGINT AS n FROM (SELECT p_partkey AS otu FROM part) CROSS JOIN (SELECT n_nationkey AS sample FROM nation) LEFT JOIN c USING (otu, sample)")
def otu_densify(spark, d):
    return otu.densify(_by_nation(spark, d), table(spark, d, "part").select(F.col("p_partkey").alias("otu")), table(spark, d, "nation").select(F.col("n_nationkey").alias("sample")))


@query(f"{W}, t AS (SELECT sample, sum(n) AS total FROM fx_otu GROUP BY sample) SELECT otu, sample, round(n * 1000.0::DOUBLE / total, 6) AS n FROM fx_otu JOIN t USING (sample)")
def otu_normalise(spark, d):
    return otu.normalise(fx_otu(spark, d), 1000.0).withColumn("n", F.round("n", 6))


@query(f"{W}, t AS (SELECT sample, sum(n) AS total FROM fx_otu GROUP BY sample) SELECT otu, sample, round(n::DOUBLE * (SELECT max(total) FROM t)::DOUBLE / total::DOUBLE, 6) AS n FROM fx_otu JOIN t USING (sample)")
def otu_normalise_auto(spark, d):
    return otu.normalise(fx_otu(spark, d)).withColumn("n", F.round("n", 6))


@query(f"{W} SELECT otu, sample, n FROM fx_otu WHERE sample IN (SELECT sample FROM fx_otu GROUP BY sample HAVING sum(n) >= 590) AND otu IN (SELECT otu FROM (SELECT * FROM fx_otu WHERE sample IN (SELECT sample FROM fx_otu GROUP BY sample HAVING sum(n) >= 590)) GROUP BY otu HAVING sum(n) >= 10)")
def otu_prune(spark, d):
    return otu.prune_otus(otu.prune_samples(fx_otu(spark, d), 590), 10)


@query("SELECT l_partkey AS otu, l_suppkey AS sample, count(*) AS n FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY ALL")
def otu_merge_full_outer(spark, d):
    items = table(spark, d, "lineitem")
    one = lambda flag: items.where(F.col("l_returnflag") == flag).groupBy(F.col("l_partkey").alias("otu"), F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("n"))
    return _n(otu.merge(one("A"), one("R")))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS otu FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT DISTINCT l_partkey AS otu FROM lineitem WHERE l_returnflag = 'R')
SELECT 'union' AS op, otu FROM (SELECT * FROM a UNION SELECT * FROM r) UNION ALL SELECT 'intersect', otu FROM (SELECT * FROM a INTERSECT SELECT * FROM r) UNION ALL SELECT 'except', otu FROM (SELECT * FROM a EXCEPT SELECT * FROM r)""")
def otu_set_ops(spark, d):
    items = table(spark, d, "lineitem")
    a, r = (items.where(F.col("l_returnflag") == f).select(F.col("l_partkey").alias("otu")).distinct() for f in ("A", "R"))
    named = lambda op, df: df.select(F.lit(op).alias("op"), "otu")
    return named("union", a.union(r).distinct()).union(named("intersect", a.intersect(r))).union(named("except", a.subtract(r)))


@query(f"{W} SELECT otu, sample, n FROM fx_otu WHERE otu IN (SELECT otu FROM fx_otu GROUP BY otu HAVING sum(n) >= 30)")
def otu_semi_join(spark, d):
    counts = fx_otu(spark, d)
    return counts.join(otu.supported(counts, 30), "otu", "left_semi")


@query(f"{W} SELECT otu, sample, n FROM fx_otu WHERE otu NOT IN (SELECT otu FROM fx_otu GROUP BY otu HAVING sum(n) >= 30)")
def otu_anti_join(spark, d):
    counts = fx_otu(spark, d)
    return counts.join(otu.supported(counts, 30), "otu", "left_anti")


@query(f"{W} SELECT sample, otu, sum(n)::BIGINT AS total FROM fx_otu GROUP BY CUBE (sample, otu)")
def otu_totals_rollup(spark, d):
    return _n(otu.totals(fx_otu(spark, d)))


@query(f"{W} SELECT otu, sum(n)::BIGINT AS n_reads, count(*) AS n_samples FROM fx_otu GROUP BY otu")
def otu_summary(spark, d):
    return otu.summary(fx_otu(spark, d))


@query(f"{W} SELECT bool_and(n <= 1) AS is_relative FROM fx_otu")
def otu_is_relative(spark, d):
    return otu.is_relative(fx_otu(spark, d))


@query("SELECT l_partkey AS otu, array_to_string(list_sort(list('o' || l_orderkey || '.' || l_linenumber)), ' ') AS read_ids FROM lineitem GROUP BY l_partkey")
def otu_read_list(spark, d):
    reads = table(spark, d, "lineitem").withColumn("read", F.concat(F.lit("o"), F.col("l_orderkey").cast("string"), F.lit("."), F.col("l_linenumber").cast("string")))
    return otu.read_lists(reads, "l_partkey", "read")


_READS = "r AS (SELECT p_size AS otu, aln FROM fx_aln JOIN part ON id = p_partkey + 1)"
_SITE = """s AS (SELECT otu, i::INT AS site, substr(aln, i, 1) AS b FROM r, LATERAL (SELECT unnest(range(1, length(aln) + 1)) AS i)),
c AS (SELECT otu, site, count(*) FILTER (b = 'A') AS a, count(*) FILTER (b = 'C') AS c, count(*) FILTER (b = 'G') AS g, count(*) FILTER (b = 'T') AS t, count(*) FILTER (b NOT IN ('A','C','G','T')) AS gap FROM s GROUP BY ALL)"""


def _aligned_reads(spark, d):
    from reedbank.plans.fixtures import ALIGNED_OF

    return table(spark, d, "part").select(F.col("p_size").alias("otu"), dna(F.col("p_partkey") + 1, ALIGNED_OF).alias("aln"))


@query(f"{with_('fx_aln')}, {_READS}, {_SITE} SELECT * FROM c")
def otu_site_counts(spark, d):
    return otu.site_counts(_aligned_reads(spark, d), "otu", "aln")


@query(f"""{with_('fx_aln')}, {_READS}, {_SITE} SELECT otu, string_agg(CASE WHEN gap > a + c + g + t THEN '-' WHEN a = greatest(a, c, g, t) THEN 'A' WHEN c = greatest(a, c, g, t) THEN 'C' WHEN g = greatest(a, c, g, t) THEN 'G' ELSE 'T' END, '' ORDER BY site) AS consensus FROM c GROUP BY otu""")
def otu_consensus(spark, d):
    return otu.consensus(otu.site_counts(_aligned_reads(spark, d), "otu", "aln"))


_SUBSET = f"""{W}, t AS (SELECT sample, sum(n) AS total FROM fx_otu GROUP BY sample),
reads AS (SELECT otu, sample, i FROM fx_otu JOIN t USING (sample), LATERAL (SELECT unnest(range(1, n + 1)) AS i) WHERE total > {DEPTH}),
k AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY md5('0|' || sample || '|' || otu || '|' || i), otu, i) AS k FROM reads),
sub AS (SELECT otu, sample, count(*) AS n FROM k WHERE k <= {DEPTH} GROUP BY ALL UNION ALL SELECT otu, sample, n FROM fx_otu JOIN t USING (sample) WHERE total <= {DEPTH})"""


@query(f"{_SUBSET} SELECT * FROM sub")
def otu_subset_uniform(spark, d):
    return otu.subset_uniform(fx_otu(spark, d), DEPTH)


@query(f"{_SUBSET} SELECT otu, sample, n FROM sub WHERE sample IN (SELECT sample FROM sub GROUP BY sample HAVING sum(n) >= {DEPTH})")
def otu_subset_pipeline(spark, d):
    return otu.rarefy(fx_otu(spark, d), DEPTH)


@query(f"""{W}, c AS (SELECT *, sum(n) OVER (PARTITION BY sample ORDER BY otu ROWS UNBOUNDED PRECEDING) - n AS first, sum(n) OVER (PARTITION BY sample) AS total FROM fx_otu),
draws AS (SELECT sample, total, unnest(range(1, {DEPTH} + 1)) AS k FROM (SELECT DISTINCT sample, total FROM c WHERE total > {DEPTH})),
r AS (SELECT sample, ('0x' || substr(md5('0|' || sample || '|' || k), 1, 15))::BIGINT % total::BIGINT AS r FROM draws)
SELECT otu, c.sample, count(*) AS n FROM r ASOF JOIN c ON r.sample = c.sample AND r.r >= c.first GROUP BY ALL UNION ALL SELECT otu, sample, n FROM c WHERE total <= {DEPTH}""")
def otu_subset_multinomial(spark, d):
    return otu.subset_multinomial(fx_otu(spark, d), DEPTH)


@query(f"""{with_('fx_aln')}, {_READS}, {_SITE} SELECT otu, count(*) FILTER (a + c + g + t + gap > 0) AS observed_sites, count(*) FILTER (a + c + g + t > 0) AS symbol_sites, count(*) FILTER (a + c + g + t + gap > 0) / 40.0::DOUBLE AS observed_fraction, count(*) FILTER (a + c + g + t > 0) / 40.0::DOUBLE AS symbol_fraction FROM c GROUP BY otu""")
def otu_site_summary(spark, d):
    return otu.site_summary(otu.site_counts(_aligned_reads(spark, d), "otu", "aln"), 40)
