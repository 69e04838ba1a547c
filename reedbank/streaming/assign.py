"""Assignment as a stream: reads arrive as files, the same stateless assignment runs on each micro-batch, OTU counts are kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.plans.assign import Options, assigner_of, model_of
from reedbank.sources.database import Database

READS = "id STRING, sample STRING, seq STRING"


def read_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of (id, sample, seq) as they come."""
    return spark.readStream.schema(READS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def otu_counts(assigned: DataFrame) -> DataFrame:
    """Running (taxon_id, sample, n): state has a row for each OTU and sample, not for reads."""
    return assigned.groupBy("taxon_id", "sample").agg(F.count("*").alias("n"))


def start(reads: DataFrame, db: Database, query_name: str, checkpoint: str, options: Options = Options(), min_q: float = 0, to=None):
    """A query that hands the counts that changed to to(batch, number), in update mode; without to it keeps the table query_name of all counts in the driver's
    memory, which suits small tables only."""
    source = reads.withColumn("mate", F.lit(None).cast("string"))
    assigned = assign_stream(source, db, options).where(F.col("taxon_id").isNotNull() & (F.col("Q_taxon") >= min_q))
    out = otu_counts(assigned).writeStream.queryName(query_name).option("checkpointLocation", checkpoint)
    return (out.outputMode("update").foreachBatch(to) if to else out.outputMode("complete").format("memory")).start()


def assign_stream(reads: DataFrame, db: Database, options: Options) -> DataFrame:
    """Adds taxon_id and Q_taxon to (sample, seq, mate); rows keep their sample by travelling in one string with the sequence."""
    packed = reads.select(F.to_json(F.struct("id", "sample")).alias("tag"), "seq", "mate")
    return _with_tag(packed, db, options).select(F.get_json_object("tag", "$.id").alias("id"), F.get_json_object("tag", "$.sample").alias("sample"), "taxon_id", "Q_taxon")


def _with_tag(packed: DataFrame, db: Database, options: Options) -> DataFrame:
    shared, token = packed.sparkSession.sparkContext.broadcast(model_of(db, options)), uuid.uuid4().hex

    def run(batches):
        import pyarrow as pa

        assigner = assigner_of(token, shared.value)
        for batch in batches:
            found = assigner.align(batch.column(1).to_pylist())
            placed = assigner.place_all(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p.get("taxon_id") for p in placed], pa.int64()), pa.array([p.get("Q_taxon") for p in placed], pa.float64())], names=["tag", "taxon_id", "Q_taxon"]
            )

    return packed.mapInArrow(run, "tag string, taxon_id bigint, Q_taxon double")
