"""Spark session with the settings that the engine is made for."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.ui.showConsoleProgress": "false",
}

#: Spark 4.1 may zip the sides of a union that have one partitioning, and fails where adaptive execution has coalesced one of them.
PLAIN_UNION = "spark.sql.unionOutputPartitioning"


def plain_unions(spark: SparkSession) -> None:
    spark.conf.set(PLAIN_UNION, "false")


def session(name: str = "reedbank", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in (SETTINGS | {PLAIN_UNION: "false"} | more).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> None:
    """Makes sure that checkpoints go to the folder that spark.checkpoint.dir names; a temporary one where that is unset and all runs in one process."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="reedbank_")
        atexit.register(shutil.rmtree, own, True)
        folder = "file://" + own
    context.setCheckpointDir(folder)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to the folder of checkpoints and read back: like cut, but computed once, and columns that aren't asked for aren't read."""
    spark = df.sparkSession
    plain_unions(spark)
    checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}_{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task widens (to sites, k-mers or pieces of text).
ROWS_A_TASK = 1 << 15


def spread(df: DataFrame, rows_each: int = ROWS_A_TASK, *keys: str) -> DataFrame:
    """df over so many tasks that each has about rows_each rows, for rows that are going to be widened: files that compress well are read by few tasks, however many
    rows they have.  With keys, rows of equal ones stay together.  df is counted, and stays as it is where one task is enough."""
    parts = -(-df.count() // rows_each)
    return df.repartition(parts, *keys) if parts > 1 else df


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join whose sides both grow with the input: sorted and merged.  Left to its own estimates Spark may collect and broadcast one, as sizes of small files say
    nothing of the rows that they are widened to."""
    return left.join(right.hint("merge"), on, how)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint, for rounds that build on each other."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
