"""What several operators share: written intermediate tables and table access."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where that is unset and all runs in one process (tests) a new temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="reedbank_")
        atexit.register(shutil.rmtree, own, True)
        found = "file://" + own
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def plain_unions(spark: SparkSession) -> None:
    """Spark 4.1 may zip the sides of a union that have one partitioning, and fails where adaptive execution has coalesced one of them."""
    spark.conf.set("spark.sql.unionOutputPartitioning", "false")


#: Folders of tables that this process has written.
_tables: list[str] = []


def drop_written() -> int:
    """Deletes the intermediate tables that this process has written so far, once results that read them are stored; the number of them."""
    from pyarrow import fs

    n = len(_tables)
    while _tables:
        store, path = fs.FileSystem.from_uri(_tables.pop())
        if store.get_file_info(path).type == fs.FileType.Directory:
            store.delete_dir(path)
    return n


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: cuts the lineage, and survives lost executors.  drop_written deletes it."""
    spark = df.sparkSession
    plain_unions(spark)
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to.  drop_written deletes what is."""
    path = f"{shared_dir(spark)}/{name}_{uuid.uuid4().hex}"
    _tables.append(path if "://" in path else "file://" + path.removeprefix("file:"))
    return path


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what goes to Python at a time: texts can be long, and batches are held on both sides."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name, "10000")) > rows:
        spark.conf.set(name, str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """body(x) with x bound to value, which is computed once a row, however often a lambda in body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def input_bytes(df: DataFrame, text: str) -> int:
    """Size of the input behind df, for numbers of parts and never for results: of its files, as the optimizer knows it, where df is a table with
    filters and columns; else the bytes of its texts are counted."""
    node = df._jdf.queryExecution().optimizedPlan()
    size = int(str(node.stats().sizeInBytes()))
    while node.children().size() == 1:
        node = node.children().apply(0)
    if node.children().size() == 0 and size < UNKNOWN:
        return size
    return int(df.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0])


#: Sizes from here on are the optimizer's default for what it doesn't know.
UNKNOWN = 1 << 60


def parts_for(df: DataFrame, text: str, bytes_each: int, least: int = 8) -> int:
    """How many parts give each about bytes_each of df's input."""
    return max(least, input_bytes(df, text) // bytes_each)


#: Keys with more than this share of a table's rows are hot; so there are no more than its inverse of them.
HOT_SHARE = 1 / 1000


def join_hot(rows: DataFrame, table: DataFrame, key: str, n_rows: int, times: str = "times", how: str = "inner") -> DataFrame:
    """rows joined with table (a row for each key, times: how often rows have it).  Rows of hot keys meet their few table rows by broadcast,
    so no key's rows are gathered in one task; all others are shuffled.  rows are read twice."""
    hot = table.where(F.col(times) > max(1000, n_rows * HOT_SHARE)).drop(times)
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(table.drop(times), key, how)
    return rows.join(F.broadcast(hot), key).unionByName(rest)
