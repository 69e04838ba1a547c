"""Operator 2: contiguous shards of near equal bytes, from global prefix sums.

Law 'bytes': rows in the order of (key, text hash, size, row number) are cut at equal targets of the running sum of sizes.  The order is made in two levels: rows are
dealt by ranges of all four into parts of about ROWS_IN_PART rows, totals of the parts are summed up on a table with a row for each part,
and running sums within the parts are windows over one part each.  Row numbers are given once and written, so ranges cut any group of equal keys, nulls or
texts, and none gathers in one window.  A row goes to the shard that holds the middle of its bytes, so a shard's size is off its target
by no more than half a row at either end.

Rows: a null text has size 1 and the hash of an empty text.  A null key comes first.  Keys of any type that has an order are taken.  Equal keys, and equal texts of a
key, stand next to each other; law 'bytes' asks for equal sizes and not for copies to stay in one shard, so groups of equal texts follow no other rule.
Repeated rows get slots of their own; they may trade them, being equal.  Other columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbank.llm.shared import read_table, written

ROWS_IN_PART = 1 << 14
ORDER = ("key", "text_crc32", "size", "row")


def shard_by_bytes(df: DataFrame, key: str = "doc_id", text: str = "text", shards: int = 16) -> DataFrame:
    """(key, size, text_crc32, shard, slot): slot counts from 0 in each shard, in the order of the key."""
    content = F.coalesce(F.col(text), F.lit(""))
    rows = written(
        df.select(
            F.col(key).alias("key"), F.crc32(content.cast("binary")).alias("text_crc32"), (F.octet_length(content) + 1).cast("long").alias("size"), F.monotonically_increasing_id().alias("row")
        ),
        "op2_rows",
    )
    parts = rows.count() // ROWS_IN_PART + 1
    placed = written(rows.repartitionByRange(parts, *ORDER).withColumn("part", F.spark_partition_id()), "op2_parts")
    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"))
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("bytes").over(up_to), F.lit(0)).alias("bytes_before"), F.sum("bytes").over(Window.partitionBy()).alias("bytes_all"))
    inside = Window.partitionBy("part").orderBy(*ORDER)
    placed = placed.select(*ORDER, "part", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"), F.row_number().over(inside).cast("long").alias("place"))
    # twice the middle of the row's bytes, so that it stays whole
    middle = 2 * (F.col("bytes_before") + F.col("upto")) - F.col("size")
    placed = placed.join(F.broadcast(offsets), "part").withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * F.col("bytes_all"))).cast("int")))
    placed = written(placed.select("key", "size", "text_crc32", "part", "place", "shard"), "op2_placed")
    # slots: a shard's rows before this part, and the place behind the shard's first row in the part
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("rows"), F.min("place").alias("first"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"))
    out = placed.join(F.broadcast(starts), ["shard", "part"])
    return out.select(F.col("key").alias(key), "size", "text_crc32", "shard", (F.col("rows_before") + F.col("place") - F.col("first")).alias("slot"))


def op2_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
