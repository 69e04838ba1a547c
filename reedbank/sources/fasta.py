"""FASTA and FASTQ: files to rows (id, description, seq, qual), and records in a text column to rows.

FASTA files are cut at the marks of records by Spark's own text reader, so a large plain file is read in splits.  FASTQ needs its lines
counted in fours; its reader is a Python data source with a partition for each SPLIT_BYTES of a plain file, which starts at the first whole record, and one for
each packed file.  Sequences are upper-cased."""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: File name endings.
FASTA_ENDINGS, FASTQ_ENDINGS, PACKED_ENDINGS = ("fasta", "fas", "fa", "fna"), ("fastq", "fq"), (".gz", ".bz2")
SCHEMA = "id STRING, description STRING, seq STRING, qual STRING"


def sniff_format(path: str) -> str:
    """fasta or fastq, by the ending in front of a compression's."""
    name = path
    for ending in PACKED_ENDINGS:
        name = name.removesuffix(ending)
    last = name.rpartition(".")[2].lower()
    if last in FASTA_ENDINGS:
        return "fasta"
    if last in FASTQ_ENDINGS:
        return "fastq"
    raise ValueError(f"can't tell the format of {path!r} from its name")


def _head(head: Column) -> tuple[Column, Column]:
    return F.regexp_extract(head, r"^(\S*)", 1), F.regexp_replace(head, r"^\S*\s*", "")


def parse_fasta(df: DataFrame, record: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, description, seq) of records, each with or without its leading '>', and the columns to keep."""
    text = F.regexp_replace(F.col(record), "^>", "")
    id_, description = _head(F.substring_index(text, "\n", 1))
    body = F.when(F.instr(text, "\n") > 0, F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise(F.lit(""))
    return df.select(id_.alias("id"), description.alias("description"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq"), *keep)


def parse_fastq(df: DataFrame, record: str) -> DataFrame:
    """(id, description, seq, qual) of four-line records; a quality of another length than the sequence's raises an error."""
    lines = F.split(F.regexp_replace(F.col(record), "^@", ""), "\n")
    id_, description = _head(F.get(lines, F.lit(0)))
    seq, qual = F.get(lines, F.lit(1)), F.get(lines, F.lit(3))
    checked = F.when(F.length(seq) == F.length(qual), qual).otherwise(F.raise_error(F.lit("sequence and quality differ in length")))
    return df.select(id_.alias("id"), description.alias("description"), F.upper(seq).alias("seq"), checked.alias("qual"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """Rows of FASTA files; gzip and bzip2 by ending.  A record starts at '>' at the start of a line."""
    raw = spark.read.option("lineSep", "\n>").text(path)
    return parse_fasta(raw.where(F.trim("value") != ""), "value")


def _numbered_fasta(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n>").text(path).where(F.trim("value") != "")
    # a block's records have ascending ids in one task
    placed = raw.select("value", F.input_file_name().alias("file"), F.input_file_block_start().alias("at"), F.monotonically_increasing_id().alias("k"))
    parsed = parse_fasta(placed, "value", keep=("file", "at", "k"))
    return parsed.withColumn("qual", F.lit(None).cast("string"))


#: Bytes of a plain FASTQ file that a task reads.
SPLIT_BYTES = 128 << 20


class _File(InputPartition):
    """Records of a file that start in the bytes [start, end); end is None for a whole file."""

    def __init__(self, path: str, start: int = 0, end: int | None = None):
        self.path, self.start, self.end = path, start, end


def _store(path: str):
    """(file system, path in it) of a local path or a URI that Arrow knows (file, hdfs, s3, gs, ...)."""
    import os

    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if re.match(r"^\w+://", path) else (fs.LocalFileSystem(), os.path.abspath(re.sub("^file:", "", path)))


def _packed(path: str) -> str | None:
    return "gzip" if path.endswith(".gz") else "bz2" if path.endswith(".bz2") else None


def _lines(path: str):
    """Lines of a file, decompressed by its ending, read as a stream."""
    import io

    store, inner = _store(path)
    with store.open_input_stream(inner, compression=_packed(path)) as raw:
        yield from io.TextIOWrapper(io.BufferedReader(raw, 1 << 20), encoding="ascii", errors="replace")


def _lines_of_split(path: str, start: int, end: int):
    """Lines of the records that start in the bytes [start, end) of a plain file."""
    import io

    store, inner = _store(path)
    with store.open_input_file(inner) as raw:
        raw.seek(max(0, start - 1))
        source = io.BufferedReader(raw, 1 << 20)
        at = max(0, start - 1)
        if start:
            # the rest of the line that the split begins in belongs to the one before
            at += len(source.readline())
        # a record begins at an @ whose third line is a + and whose second and fourth have one length: a quality line with an @ is followed by a head and a sequence
        window: list[bytes] = []
        while start and at < end:
            while len(window) < 4 and (line := source.readline()):
                window.append(line)
            if len(window) < 4:
                # the end of the last record, or one that is cut off
                while window and not window[0].startswith(b"@"):
                    window.pop(0)
                if len(window) > 1:
                    raise ValueError(f"record {window[0]!r} is cut off")
                return
            head, seq, plus, qual = (x.rstrip(b"\r\n") for x in window)
            if head.startswith(b"@") and plus.startswith(b"+") and len(seq) == len(qual):
                break
            at += len(window.pop(0))
        while at < end:
            record = [window.pop(0) if window else source.readline() for _ in range(4)]
            if not record[0]:
                return
            if not record[0].strip():
                # an empty line between records
                at += len(record[0])
                window = [x for x in (*record[1:], *window) if x]
                continue
            at += sum(map(len, record))
            yield from (x.decode("ascii", "replace") for x in record if x)


def fastq_records(lines):
    """(id, description, seq, qual) from an iterator of lines."""
    lines = iter(lines)
    for head in lines:
        head = head.rstrip("\n\r")
        if not head:
            continue
        rest = [x.rstrip("\n\r") for x in itertools.islice(lines, 3)]
        if len(rest) < 3:
            raise ValueError(f"record {head!r} is cut off")
        seq, _, qual = rest
        if not head.startswith("@") or len(seq) != len(qual):
            raise ValueError(f"record {head!r} isn't FASTQ")
        name, _, description = head[1:].partition(" ")
        yield name, description, seq.upper(), qual


class FastqReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def files(self):
        """(path, size) in the order of names."""
        import glob

        from pyarrow import fs

        if "*" in self.path and "://" not in self.path:
            return [(p, fs.LocalFileSystem().get_file_info(p).size) for p in sorted(glob.glob(self.path))]
        store, inner = _store(self.path)
        info = store.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type != fs.FileType.Directory:
            return [(self.path, info.size)]
        found = store.get_file_info(fs.FileSelector(inner))
        return [(f"{self.path.rstrip('/')}/{f.base_name}", f.size) for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]

    def partitions(self):
        out = []
        for path, size in self.files():
            if _packed(path) or size <= SPLIT_BYTES:
                out.append(_File(path))
            else:
                out += [_File(path, at, min(size, at + SPLIT_BYTES)) for at in range(0, size, SPLIT_BYTES)]
        return out

    def read(self, partition):
        lines = _lines(partition.path) if partition.end is None else _lines_of_split(partition.path, partition.start, partition.end)
        for k, record in enumerate(fastq_records(lines)):
            yield (*record, partition.path, partition.start, k)


class FastqSource(DataSource):
    """spark.read.format("fastq").load(path), after register(spark): records with the file and the split that they come from and their number in it."""

    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA + ", file STRING, at LONG, k LONG"

    def reader(self, schema):
        return FastqReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastqSource)


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    return _numbered_fastq(spark, path).drop("file", "at", "k")


def _numbered_fastq(spark: SparkSession, path: str) -> DataFrame:
    register(spark)
    return spark.read.format("fastq").load(path)


def numbered_sequences(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Reads of either format with ordinal, their number from 0 in the files in the order of names.

    Records are counted by split of the input, and a split's first number is the sum of those before: what is ordered as a whole are splits."""
    rows = _numbered_fasta(spark, path) if (fmt or sniff_format(path)) == "fasta" else _numbered_fastq(spark, path)
    splits = rows.groupBy("file", "at").agg(F.count("*").alias("n"), F.min("k").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = splits.select("file", "at", (before - F.col("first")).alias("offset"))
    return rows.join(F.broadcast(starts), ["file", "at"]).withColumn("ordinal", F.col("k") + F.col("offset")).drop("file", "at", "k", "offset")


def write_alignment(rows: DataFrame, path: str, name: str = "name", aligned: str = "aln") -> None:
    """An alignment as FASTA, the inverse of read_fasta."""
    from reedbank.functions.sequence import fasta

    rows.select(fasta(F.col(name), F.lit(None).cast("string"), F.col(aligned))).write.mode("overwrite").text(path)


def read_sequences(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """Reads of either format, with qual null for FASTA."""
    if (fmt or sniff_format(path)) == "fasta":
        return read_fasta(spark, path).withColumn("qual", F.lit(None).cast("string"))
    return read_fastq(spark, path)
