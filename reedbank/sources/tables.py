"""Tab-separated tables: assignments, OTU tables, taxonomies, sample lists, regions; with a line that names program and version in front."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank import __version__
from reedbank.operators import otu
from reedbank.operators.assignment import ASSIGNMENT


def _tsv(spark: SparkSession, path, schema: str | None, header: bool) -> DataFrame:
    reader = spark.read.options(sep="\t", header=header, comment="#", mode="FAILFAST")
    return (reader.schema(schema) if schema else reader).csv(path)


def program_line(info: str = "") -> str:
    return f"# reedbank v{__version__} {info}".rstrip()


def check_program_line(line: str, most: str = __version__) -> None:
    """Refuses a file of another program or of a later version."""
    parts = line.lstrip("# ").split()
    if len(parts) < 2 or parts[0] != "reedbank":
        raise ValueError("the file isn't one of this program's")
    number = lambda v: [int(x) for x in v.lstrip("v").split(".")]
    if number(parts[1]) > number(most):
        raise ValueError(f"the file is of the later version {parts[1]}")


def read_assignments(spark: SparkSession, path) -> DataFrame:
    """Assignment tables with their file's name in column file."""
    return _tsv(spark, path, ASSIGNMENT, True).withColumn("file", F.input_file_name())


def write_assignments(df: DataFrame, path: str) -> None:
    """Missing placements are written as the words that the table's readers know."""
    filled = df.select(
        *[
            F.coalesce(c, F.lit(word)).alias(name) if word else c.alias(name)
            for name in df.columns
            for c, word in [(F.col(name), {"branch_id": "NULL", "taxon_anno": "UNASSIGNED"}.get(name))]
        ]
    )
    filled.write.mode("overwrite").options(sep="\t", header=True, nullValue="").csv(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(name, anno, line): line orders repeated names within a file."""
    return _tsv(spark, path, "name STRING, anno STRING", False).withColumn("line", F.monotonically_increasing_id())


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "sample STRING, file STRING", False)


def read_regions(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(chrom, start, end), 0-based half open, within width columns."""
    rows = _tsv(spark, path, "chrom STRING, start INT, end INT", False)
    return rows.where((F.col("start") >= 0) & (F.col("start") < F.col("end")) & (F.col("end") <= width))


def read_otu_table(spark: SparkSession, path: str) -> DataFrame:
    """Long form (otu, taxonomy, sample, n) of a wide table otuID, samples, taxonomy."""
    raw = _tsv(spark, path, None, True)
    wide = raw.select(F.col("otuID").alias("otu"), "taxonomy", *[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns if c not in ("otuID", "taxonomy")])
    return otu.unpivot(wide, ("otu", "taxonomy"), keep_zeros=True)


def write_otu_table(long: DataFrame, path: str) -> None:
    """Wide table in the order of OTUs; the sample names are the one thing that is asked of the data."""
    samples = [r[0] for r in long.select("sample").distinct().orderBy("sample").toLocalIterator()]
    counts = otu.pivot(long, samples, name=str)
    taxonomy = long.groupBy("otu").agg(F.min("taxonomy").alias("taxonomy"))
    counts.join(taxonomy, "otu").orderBy("otu").select(F.col("otu").alias("otuID"), *[F.col(f"`{s}`") for s in map(str, samples)], "taxonomy").coalesce(1).write.mode("overwrite").options(sep="\t", header=True).csv(path)
