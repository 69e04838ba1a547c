"""Sequence-like views of the driver's tables, the same in Spark and in SQL; nothing is written to disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.operators import otu
from reedbank.session import spread

HEX = "0123456789abcdef"
DNA_OF, ALIGNED_OF = "ACGTACGTACGTACGT", "ACGTACGTACGTA--T"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def dna(key, target: str = DNA_OF):
    return F.translate(F.md5(key.cast("string").cast("binary")), HEX, target)


def fx_seq(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") + 1).alias("id"), dna(F.col("p_partkey") + 1).alias("seq"))


def fx_aln(spark, d):
    return table(spark, d, "part").select((F.col("p_partkey") + 1).alias("id"), dna(F.col("p_partkey") + 1, ALIGNED_OF).alias("aln"))


def fx_node(spark, d):
    key = F.col("p_partkey") + 1
    return table(spark, d, "part").select(key.alias("id"), F.when(key > 1, F.floor(key / 2)).alias("parent"), (F.col("p_size") / 100).alias("length"), F.concat_ws("|", "p_brand", "p_type").alias("name"))


def fx_assign(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.col("l_partkey") + 1).alias("taxon_id"), (F.col("l_discount") * 1000).alias("q_taxon"))


def fx_otu(spark, d):
    items = spread(table(spark, d, "lineitem").select("l_partkey", "l_suppkey"), otu.CELLS_A_TASK, "l_partkey", "l_suppkey")
    return items.groupBy(F.col("l_partkey").alias("otu"), F.col("l_suppkey").alias("sample")).agg(F.count("*").alias("n"))


def fx_place(spark, d):
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_orderkey").alias("read"), (F.col("l_partkey") + 1).alias("node"))
        .agg(F.max(-F.col("l_extendedprice") / 10000).alias("loglik"))
        .withColumn("taxon", F.col("node") % 7)
    )


def fx_taxon(spark, d):
    t = lambda n: table(spark, d, n)
    joined = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("c_custkey").alias("id"), F.concat(F.lit("k__"), "r_name", F.lit("; p__"), "n_name", F.lit("; c__"), "c_mktsegment", F.lit("; s__")).alias("taxonomy"))


def fx_read(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("read"), dna(F.concat(F.lit("r"), F.col("s_suppkey").cast("string"))).alias("seq"))


_T = "translate(md5(CAST({} AS VARCHAR)), '0123456789abcdef', '{}')"
#: The same views for DuckDB, as common table expressions.
CTE = {
    "fx_seq": f"fx_seq AS (SELECT p_partkey + 1 AS id, {_T.format('p_partkey + 1', DNA_OF)} AS seq FROM part)",
    "fx_aln": f"fx_aln AS (SELECT p_partkey + 1 AS id, {_T.format('p_partkey + 1', ALIGNED_OF)} AS aln FROM part)",
    "fx_node": "fx_node AS (SELECT p_partkey + 1 AS id, CASE WHEN p_partkey > 0 THEN (p_partkey + 1) // 2 END AS parent, p_size / 100.0::DOUBLE AS length, p_brand || '|' || p_type AS name FROM part)",
    "fx_assign": "fx_assign AS (SELECT l_suppkey AS sample, l_partkey + 1 AS taxon_id, l_discount * 1000 AS q_taxon FROM lineitem)",
    "fx_otu": "fx_otu AS (SELECT l_partkey AS otu, l_suppkey AS sample, count(*) AS n FROM lineitem GROUP BY ALL)",
    "fx_place": "fx_place AS (SELECT l_orderkey AS read, l_partkey + 1 AS node, max(-l_extendedprice / 10000) AS loglik, (l_partkey + 1) % 7 AS taxon FROM lineitem GROUP BY l_orderkey, l_partkey)",
    "fx_taxon": "fx_taxon AS (SELECT c_custkey AS id, 'k__' || r_name || '; p__' || n_name || '; c__' || c_mktsegment || '; s__' AS taxonomy FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)",
    "fx_read": f"fx_read AS (SELECT s_suppkey AS read, {_T.format("'r' || s_suppkey", DNA_OF)} AS seq FROM supplier)",
    "sites": "sites AS (SELECT id, s AS site, CASE WHEN substr(aln, s, 1) IN ('A','C','G','T') THEN substr(aln, s, 1) ELSE '-' END AS base FROM fx_aln, LATERAL (SELECT unnest(range(1, length(aln) + 1))::INT AS s))",
}


def with_(*names: str, recursive: bool = False) -> str:
    return "WITH " + "RECURSIVE " * recursive + ",\n".join(CTE[n] for n in names)
