"""Reads as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_sequences(reads: DataFrame, read: str = "id", seq: str = "seq") -> DataFrame:
    """(seq, n_reads, first_id): equal reads are aligned and placed once, and joined back by sequence."""
    return reads.groupBy(F.col(seq).alias("seq")).agg(F.count("*").alias("n_reads"), F.min(read).alias("first_id"))
