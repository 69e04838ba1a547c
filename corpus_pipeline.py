"""A corpus pipeline of five operators; part of the subpackage reedbank.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next stage's docs.  All
stages but the last return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm import op07_quality_knn as quality
from reedbank.llm.op01_ngram_join import jaccard_components
from reedbank.llm.op04_decontaminate import drop_contaminated
from reedbank.llm.op09_secrets import redact
from reedbank.llm.op10_bpe import bpe_round_trip
from reedbank.llm.shared import read_table, written


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold stay."""
    model = quality.train(docs, read_table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by similar shingles the one with the smallest doc_id stays; a document without words is a group of its own."""
    # the text's hash tells rows apart that share a doc_id; rows that share both are settled by a hash of all their columns
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text"), F.struct(F.col("doc_id"), F.xxhash64("text").alias("mark")).alias("key"))
    first = jaccard_components(rows.select("key", "text"), "key").where(F.col("key") == F.col("component_id")).select("key").distinct()
    kept = rows.drop("text").join(first, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
    return kept.select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of a benchmark item go."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by their kind; n_chars follows the text."""
    out = redact(docs)
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): token ids, and the digest of what they decode to."""
    out = bpe_round_trip(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", classify),
    ("n-gram Jaccard join", dedup),
    ("benchmark decontamination", decontaminate),
    ("secret scans", hide_secrets),
    ("BPE encoding", encode),
]

#: SQL cannot express the classifier; the pipeline is tested against plain versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place + 1 < len(STAGES):
            docs = written(docs, f"pipeline_{place}")
    return docs
