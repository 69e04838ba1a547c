"""Chimera scan of reads that are made of two rows of the alignment."""

from pyspark.sql import functions as F

from reedbank.kernels.models import jc69
from reedbank.operators import chimera, contraction
from reedbank.plans.fixtures import fx_aln, with_
from reedbank.plans.registry import query
from reedbank.session import meet, spread

LENGTH = 0.05
#: Candidates of read k among the nodes: some near it in the tree, the two that it is made of among them for most reads.
_NEAR = ("k", "2 * k", "2 * k + 1", "k // 2", "k + 1")


@query(f"""{with_("fx_aln")}, r AS (SELECT a.id AS k, substr(a.aln, 1, 8 + a.id % 17) || substr(b.aln, 9 + a.id % 17) AS seq FROM fx_aln a JOIN fx_aln b ON b.id = 2 * a.id),
c AS (SELECT DISTINCT k, n.id AS node, n.aln, seq FROM r, LATERAL (SELECT unnest([{", ".join(_NEAR)}]) AS id) AS x JOIN fx_aln n ON n.id = x.id),
e AS (SELECT exp(-4.0::DOUBLE / 3 * {LENGTH}) AS e),
s AS (SELECT k, node, i::INT AS site, CASE WHEN substr(seq, i::INT, 1) = '-' THEN 0.0::DOUBLE WHEN substr(aln, i::INT, 1) = '-' THEN ln(0.25::DOUBLE) WHEN substr(seq, i::INT, 1) = substr(aln, i::INT, 1) THEN ln(0.25::DOUBLE + 0.75::DOUBLE * e) ELSE ln(0.25::DOUBLE - 0.25::DOUBLE * e) END AS l
  FROM c, e, LATERAL (SELECT unnest(range(1, 33)) AS i)),
w AS (SELECT k, node, site, round(sum(l) OVER (PARTITION BY k, node ORDER BY site), 9) AS a, sum(l) OVER (PARTITION BY k, node) AS t FROM s),
v AS (SELECT k, node, site, a, round(t - a, 9) AS z, round(t, 9) AS t FROM w WHERE site BETWEEN 4 AND 28),
m AS (SELECT k, site, max(a) AS ma, max(z) AS mz, max(t) AS mt, count(*) AS n FROM v GROUP BY k, site),
b AS (SELECT *, round(ma + mz, 6) AS sides FROM m WHERE n > 1 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round(ma + mz, 6) DESC, site) = 1),
f AS (SELECT v.k, v.node AS five, a AS fa, z AS fz FROM v JOIN b ON b.k = v.k AND b.site = v.site WHERE a = ma QUALIFY row_number() OVER (PARTITION BY v.k ORDER BY v.node) = 1),
g AS (SELECT v.k, v.node AS three, a AS ga, z AS gz FROM v JOIN b ON b.k = v.k AND b.site = v.site WHERE z = mz QUALIFY row_number() OVER (PARTITION BY v.k ORDER BY v.node) = 1)
SELECT b.k AS read, b.site, five, three, round(sides - mt, 5) + 0.0 AS gain, round(fa - ga + gz - fz, 5) + 0.0 AS lod FROM b JOIN f ON f.k = b.k JOIN g ON g.k = b.k""")
def chimera_scan(spark, d):
    """The best breakpoint of each made read, the nodes on its sides, and how much better they are than one node, and than exchanged."""
    rows = fx_aln(spark, d)
    k = F.col("read")
    of = rows.select((F.col("id") / 2).cast("long").alias("read"), F.col("aln").alias("other"), "id").where("id % 2 = 0")
    at = (8 + k % 17).cast("int")
    made = meet(rows.select(F.col("id").alias("read"), "aln"), of.drop("id"), "read").select("read", F.concat(F.substring("aln", F.lit(1), at), F.substring("other", at + 1, F.length("other"))).alias("seq"))
    near = F.array_distinct(F.array(k, 2 * k, 2 * k + 1, F.floor(k / 2), k + 1))
    sites = spread(made).select("read", F.explode(near).alias("node"), F.posexplode(F.split("seq", "")).alias("site", "base")).where("base <> ''").withColumn("site", F.col("site") + 1)
    leaf = contraction.leaf_sites(rows)
    weights = leaf.select("id", "site", *[F.when(F.col("base").isin(*"ACGT"), (F.col("base") == b.upper()).cast("double")).otherwise(0.25).alias(f"w{b}") for b in "acgt"])
    out = chimera.scan(chimera.site_scores(sites, weights, jc69(), LENGTH), 4)
    return out.select("read", "site", "five", "three", (F.round("gain", 5) + 0.0).alias("gain"), (F.round("lod", 5) + 0.0).alias("lod"))
