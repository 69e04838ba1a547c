"""Operator 9: secret scans over an incremental ledger of blobs, with Spark expressions only.

Every version of a text is addressed by the SHA-256 of its content.  The ledger is a folder of tables; a row says which rules, each with its version, a blob
was scanned by, and what they found.  A scan, the first one too, goes one way: thin rows without texts are grouped by blob and held against the ledger; of
each blob that lacks a rule one row is chosen; the chosen rows are scanned by the rules that are missing, what they find is added to the ledger, and findings are
joined back to all paths (here: keys, or whole rows that are redacted) that hold a blob.

No text is moved to be scanned: which rows are chosen reaches the texts as bit maps of hashes, of a bounded size (MOST_BUCKETS of 4 KB), so texts are read once more and scanned where they
lie.  A row that the bit maps take for a chosen one is scanned in vain, which costs time only; the same holds for rows that are equal in all columns.  Joining back, bit maps of the
blobs with findings leave the other rows where they are, and blobs of very many paths do without a shuffle.

Positions: a rule's matches and the pieces between them are both cut out by the same regular expression, and running
sums of their lengths in code points are the spans.

Rows: a null text is the empty blob.  A null key is kept, repeated rows each get the blob's findings.  Other columns are ignored, whatever their names.  Whole
texts are scanned, however long.  Two scans may add to one ledger at a time; what both add counts once.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from reedbank.llm.shared import join_hot, let, new_folder, read_table, written

#: Bit maps of 32,768 bits each that are broadcast at most.
MOST_BUCKETS = 4096
SPANS = "array<struct<start:int,end:int>>"
#: Kind, regular expression, group that is measured, its least number of characters; the first three are the base.
RULES = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}", 0, 1),
)
BASE_KINDS = ("assign", "access", "hex")


def rule_version(rule: tuple) -> str:
    import hashlib

    return hashlib.sha256(repr(rule[1:]).encode()).hexdigest()[:16]


def rule_spans(text: Column, pattern: str, group: int, least: int) -> Column:
    """Spans [start, end) in code points of the leftmost non-overlapping matches whose group has at least least characters."""

    def walk(whole: Column) -> Column:
        return F.aggregate(
            F.arrays_zip(whole["gaps"].alias("gap"), whole["found"].alias("hit"), whole["measured"].alias("m")),
            F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPANS})").alias("spans")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.coalesce(x["hit"], F.lit(0))).alias("at"),
                F.when(
                    x["m"] >= least,
                    F.concat(acc["spans"], F.array(F.struct((acc["at"] + x["gap"]).alias("start"), (acc["at"] + x["gap"] + x["hit"]).alias("end")))),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    lengths = lambda strings: F.transform(strings, lambda s: F.length(s))
    parts = F.struct(
        lengths(F.split(text, pattern, -1)).alias("gaps"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).alias("found"),
        lengths(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))).alias("measured"),
    )
    return F.when(text.rlike(pattern), let(parts, walk)).otherwise(F.expr(f"cast(array() as {SPANS})"))


def blob_id(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


#: What a ledger's tables hold: the blob, "kind:version" of the rules that it was scanned by, and their findings.
HITS = "array<struct<start:int,rule:string,end:int>>"
LEDGER = f"blob string, done array<string>, hits {HITS}"
FOUND = "array<struct<start:int,place:int,kind:string,end:int>>"


def rule_names(rules: tuple) -> list[str]:
    return [f"{r[0]}:{rule_version(r)}" for r in rules]


def hits_of(text: Column, rules: tuple) -> Column:
    """Findings of the rules in text."""
    return F.concat(*[F.transform(rule_spans(text, pattern, group, least), _named(name)) for name, (_, pattern, group, least) in zip(rule_names(rules), rules, strict=True)])


def _named(name: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(name).alias("rule"), s["end"].alias("end"))


def found_of(hits: Column, rules: tuple) -> Column:
    """Findings of the current rules, by start and then by the rules' order."""
    names = F.array(*[F.lit(n) for n in rule_names(rules)])
    mine = F.filter(hits, lambda h: F.array_contains(names, h["rule"]))
    shown = F.transform(mine, lambda h: F.struct(h["start"], (F.array_position(names, h["rule"]) - 1).cast("int").alias("place"), F.substring_index(h["rule"], ":", 1).alias("kind"), h["end"]))
    return F.array_sort(shown).cast(FOUND)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger with a row for each blob, or None where there is none yet."""
    try:
        rows = spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error.getCondition()):
            raise
        return None
    # a blob has a row for each scan that found a rule missing
    return rows.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("done"))).alias("done"), F.array_distinct(F.flatten(F.collect_list("hits"))).alias("hits"))


def add_to_ledger(rows: DataFrame, folder: str) -> None:
    rows.select("blob", "done", F.col("hits").cast(HITS).alias("hits")).write.mode("append").parquet(folder)


def _place(mark: Column, buckets: int) -> tuple[Column, Column]:
    """The bit map and the bit that stand for a 64-bit hash."""
    return F.pmod(mark, F.lit(buckets)), F.pmod(F.xxhash64(mark), F.lit(1 << 15))


def bit_maps(marks: DataFrame, n: int) -> tuple[DataFrame, int]:
    """(bucket, bits) of the n hashes in marks (mark), to be broadcast: 64 bits for each while that is no more than MOST_BUCKETS bit maps, and their number."""
    buckets = max(1, min(MOST_BUCKETS, max(64, n * 64 >> 15)))
    bucket, bit = _place(F.col("mark"), buckets)
    return F.broadcast(marks.groupBy(bucket.alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))), buckets


def with_maybe(rows: DataFrame, mark: Column, maps: DataFrame, buckets: int) -> DataFrame:
    """rows with maybe: whether mark is among the hashes of the bit maps; always for those that are, seldom for others."""
    bucket, bit = _place(F.col("_mark"), buckets)
    byte = F.conv(F.hex(F.substring("bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    out = rows.withColumn("_mark", mark).withColumn("bucket", bucket).join(maps, "bucket", "left")
    return out.withColumn("maybe", F.col("bits").isNotNull() & (F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) == 1)).drop("_mark", "bucket", "bits")


def _scan(source: DataFrame, folder: str, rules: tuple, is_thin: bool) -> DataFrame:
    """(row, found) for each row of source (row, content, blob, mark), by the ledger in folder, which is brought up to date.  mark: a hash that tells rows with one blob apart.
    is_thin: row holds no text, so the rows are written with their blobs, and content addresses are made once."""
    spark, nothing = source.sparkSession, F.expr(f"cast(array() as {HITS})")
    ledger, names = read_ledger(spark, folder), F.array(*[F.lit(n) for n in rule_names(rules)])
    rows = written(source.select("row", "blob", "mark"), "op9_versions") if is_thin else source.select("row", "blob", "mark")
    blobs = rows.groupBy("blob").agg(F.count("*").alias("times"), F.min("mark").alias("mark"))
    if ledger is None:
        known = blobs.select("*", nothing.alias("hits"), names.alias("missing"))
    else:
        missing = F.array_except(names, F.coalesce("done", F.expr("cast(array() as array<string>)")))
        known = blobs.join(ledger, "blob", "left").select("blob", "times", "mark", F.coalesce("hits", nothing).alias("hits"), missing.alias("missing"))
    known = written(known, "op9_known")
    # sets of missing rules: one on a first run, otherwise as many as the ledger's scans have left, of the few that the rules have
    stats = known.groupBy("missing").agg(F.count("*").alias("n"), F.sum("times").alias("times")).collect()
    n_rows, hits = sum(r.times for r in stats), known.select("blob", "times", "hits")
    new = None
    for asked in (r for r in stats if r.missing):
        chosen = known.where(F.col("missing") == F.array(*[F.lit(m) for m in asked.missing])).select("blob", "mark")
        due = tuple(r for r, name in zip(rules, rule_names(rules), strict=True) if name in asked.missing)
        told = with_maybe(source.select("content", "blob", "mark"), F.col("mark"), *bit_maps(chosen.select("mark"), asked.n)).where("maybe")
        scanned = told.select("blob", hits_of(F.col("content"), due).alias("new")).groupBy("blob").agg(F.first("new").alias("new"))
        scanned = scanned.join(chosen.select("blob"), "blob", "left_semi").withColumn("done", F.array(*[F.lit(m) for m in asked.missing]))
        new = scanned if new is None else new.unionByName(scanned)
    if new is not None:
        new = written(new, "op9_new")
        add_to_ledger(new.select("blob", "done", F.col("new").alias("hits")), folder)
        hits = hits.join(new.where(F.size("new") > 0).select("blob", "new"), "blob", "left").select("blob", "times", F.concat("hits", F.coalesce("new", nothing)).alias("hits"))
    found = written(hits.select("blob", "times", found_of(F.col("hits"), rules).alias("found")).where(F.size("found") > 0), "op9_found")
    told = with_maybe(rows.drop("mark"), F.xxhash64("blob"), *bit_maps(found.select(F.xxhash64("blob").alias("mark")), found.count()))
    none = F.expr(f"cast(array() as {FOUND})")
    clean = told.where("not maybe").select("row", none.alias("found"))
    return join_hot(told.where("maybe").drop("maybe"), found, "blob", n_rows, how="left").select("row", F.coalesce("found", none).alias("found")).unionByName(clean)


def scan(versions: DataFrame, folder: str, key: str = "doc_id", text: str = "text", rules: tuple = RULES) -> DataFrame:
    """(key, found) for every row of versions, by the ledger in folder, which is brought up to date: found has (start, place of the kind, kind, end)."""
    content = F.coalesce(F.col(text), F.lit(""))
    source = versions.select(F.col(key).alias("row"), content.alias("content"), blob_id(content).alias("blob"), F.xxhash64(key, content).alias("mark"))
    return _scan(source, folder, rules, True).withColumnRenamed("row", key)


def redact(df: DataFrame, text: str = "text", rules: tuple = RULES, ledger: str | None = None) -> DataFrame:
    """df with each found span of text replaced by [kind]; spans that touch or overlap are replaced as one, named after the first.  Rows
    without a finding stay as they are.  ledger: a folder that keeps what runs have scanned; without one a new ledger is started."""
    columns, content = df.columns, F.coalesce(F.col(f"`{text}`"), F.lit(""))
    row = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)])
    told = [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, MapType | VariantType)]
    source = df.select(row.alias("row"), content.alias("content"), blob_id(content).alias("blob"), F.xxhash64(*told).alias("mark"))
    old = F.col(f"row.c{columns.index(text)}")

    def rebuild(spans: Column) -> Column:
        step = lambda acc, x: F.struct(
            F.when(x["start"] >= acc["at"], F.concat(acc["out"], F.substring(old, acc["at"] + 1, x["start"] - acc["at"]), F.lit("["), x["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        )
        done = F.aggregate(spans, F.struct(F.lit("").alias("out"), F.lit(0).alias("at")), step, lambda acc: F.concat(acc["out"], F.substring(old, acc["at"] + 1, F.length(old))))
        return F.when(F.size(spans) == 0, old).otherwise(done)

    out = _scan(source, ledger or new_ledger(df.sparkSession), rules, False)
    new = F.when(old.isNotNull(), let(F.col("found"), rebuild))
    return out.select(*[(new if c == text else F.col(f"row.c{i}")).alias(c) for i, c in enumerate(columns)])


def new_ledger(spark: SparkSession) -> str:
    """A folder for a ledger that no run has written yet; drop_written deletes it."""
    return new_folder(spark, "op9_ledger")


def span_list(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op9_secrets(spark: SparkSession, sf_dir: str, ledger: str | None = None) -> DataFrame:
    """ledger: a folder that keeps what runs have scanned.  Without one a run starts a new ledger in the shared folder, so that neither its results nor its
    time lean on an earlier run."""
    out = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"), ledger or new_ledger(spark))
    n = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("found", lambda s: s["kind"].isin(*BASE_KINDS))
    return out.select("doc_id", *map(n, BASE_KINDS), F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("found")).alias("spans"))
