"""Operator 7: quality by nearest-neighbour voting in a latent-semantic space.

A text's features are hashed words (log counts by inverse document frequency, unit length), how often ASCII punctuation stands per word, and how much
of it repeats.  A truncated singular value decomposition of the labelled sample's features gives DIMS latent directions.  The sample's unit
vectors and labels are broadcast; every document's cosines to all of them come from blocked matrix products, and the NEIGHBOURS nearest vote with their label by
similarity to the power SHARPNESS.

The sample is bounded: at most SAMPLE labelled keys, the ones with the smallest hashes, each with one text (the one with the smallest hash), so the model's size
does not depend on the input.  Texts with the same features are one neighbour, whose label is their labels' mean, and neighbours stand in the order of
their features; of neighbours with the same cosine the first ones vote.  So scores do not depend on the order of rows.  Rows whose crc32 of the key (as text) is 0 modulo 5 are held out and never learnt from.

Rows: null and empty texts, and texts without features, score 0.  Null keys are scored and never learnt from.  Repeated label rows count as
their smallest label, null labels not at all; without labels every score is 0.  Other columns are ignored.  Whole texts are used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm import textops as X
from reedbank.llm.shared import read_table

SAMPLE, BUCKETS, DIMS, NEIGHBOURS, SHARPNESS, THRESHOLD = 4096, 4096, 48, 15, 8, 0.3
#: ASCII bytes that are neither letters, digits nor white space.
MARKS = np.array([b for b in range(0x21, 0x7F) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)])
WIDTH = BUCKETS + len(MARKS) + 3


def block_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of a block's rows before weighting, sparse: (row, column, value), rows ascending; words are counted."""
    n = len(offsets) - 1
    words = X.Words(data, offsets, X.NON_SPACE)
    row, counts = words.row_of(), words.counts
    each = np.maximum(counts, 1)
    keys, times = np.unique(row * BUCKETS + (words.hash % np.uint64(BUCKETS)).astype(np.int64), return_counts=True)
    r, c, v = [keys // BUCKETS], [keys % BUCKETS], [1 + np.log(times)]
    place = np.full(256, -1)
    place[MARKS] = np.arange(len(MARKS))
    at = place[data]
    marks = np.flatnonzero(at >= 0)
    owner = np.searchsorted(offsets, marks, side="right") - 1
    keys, times = np.unique(owner * len(MARKS) + at[marks], return_counts=True)
    who = keys // len(MARKS)
    r, c, v = [*r, who], [*c, BUCKETS + keys % len(MARKS)], [*v, np.sqrt(times / each[who])]
    runs = X.run_hashes(words.hash, 5)
    if len(runs):
        ok = X.valid_runs(words.first, 5, len(runs))
        own = row[: len(runs)][ok]
        with np.errstate(over="ignore"):
            mixed = X.mix64(runs[ok] + own.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        _, back, times = np.unique(mixed, return_inverse=True, return_counts=True)
        again = np.bincount(own, weights=times[back] > 1, minlength=n) / np.maximum(counts - 4, 1)
        some = np.flatnonzero(again > 0)
        r, c, v = [*r, some], [*c, np.full(len(some), WIDTH - 2)], [*v, 2 * np.sqrt(again[some])]
    if len(row) > 1:
        twin = np.flatnonzero((words.hash[1:] == words.hash[:-1]) & (row[1:] == row[:-1]))
        share = np.bincount(row[twin], minlength=n) / each
        some = np.flatnonzero(share > 0)
        r, c, v = [*r, some], [*c, np.full(len(some), WIDTH - 3)], [*v, 1.5 * np.sqrt(share[some])]
    some = np.flatnonzero(counts > 0)
    r, c, v = [*r, some], [*c, np.full(len(some), WIDTH - 1)], [*v, np.minimum(1.0, 10 / counts[some])]
    r, c, v = np.concatenate(r), np.concatenate(c), np.concatenate(v)
    order = np.argsort(r, kind="stable")
    return r[order], c[order], v[order].astype(np.float32)


def weigh(row: np.ndarray, column: np.ndarray, value: np.ndarray, idf: np.ndarray, n: int) -> np.ndarray:
    """Values with words weighted and scaled to unit length in each row."""
    value = value * idf[column]
    word = column < BUCKETS
    norm = np.sqrt(np.bincount(row[word], weights=value[word] ** 2, minlength=n))
    return np.where(word, value / np.maximum(norm[row], 1e-9), value).astype(np.float32)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)


def fit(rows: list[tuple[np.ndarray, np.ndarray, float]], dims: int = DIMS) -> dict:
    """rows: (columns, values, label) of the sample, in any order."""
    alike: dict[tuple[bytes, bytes], tuple[np.ndarray, np.ndarray, list[float]]] = {}
    for c, v, label in rows:
        alike.setdefault((c.tobytes(), v.tobytes()), (c, v, []))[2].append(label)
    rows = [(c, v, sum(labels) / len(labels)) for _, (c, v, labels) in sorted(alike.items())]
    n = len(rows)
    if not n:
        return {"empty": True}
    row = np.repeat(np.arange(n), [len(r[0]) for r in rows])
    column, value = np.concatenate([r[0] for r in rows]).astype(np.int64), np.concatenate([r[1] for r in rows])
    seen = np.bincount(column, minlength=WIDTH)
    idf = np.log((1 + n) / (1 + seen)) + 0.05
    idf[BUCKETS:] = 1
    dense = np.zeros((n, WIDTH), np.float32)
    dense[row, column] = weigh(row, column, value, idf, n)
    # randomised range finder with power steps
    dims = min(dims, n, WIDTH)
    basis = dense.T @ np.random.default_rng(7).standard_normal((n, min(n, dims + 16))).astype(np.float32)
    for _ in range(4):
        basis = dense.T @ (dense @ np.linalg.qr(basis)[0])
    basis = np.linalg.qr(basis)[0]
    _, _, right = np.linalg.svd(dense @ basis, full_matrices=False)
    directions = (basis @ right.T[:, :dims]).astype(np.float32)
    return {"idf": idf, "directions": directions, "vectors": unit(dense @ directions).astype(np.float32), "labels": np.array([r[2] for r in rows], np.float32)}


def score_block(data: np.ndarray, offsets: np.ndarray, model: dict, neighbours: int = NEIGHBOURS) -> np.ndarray:
    n = len(offsets) - 1
    out = np.zeros(n)
    if "empty" in model:
        return out
    row, column, value = block_features(data, offsets)
    if not len(row):
        return out
    value = weigh(row, column, value, model["idf"], n)
    latent = np.zeros((n, model["directions"].shape[1]), np.float32)
    start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    for a in range(0, len(start), 512):
        lo, hi = start[a], start[a + 512] if a + 512 < len(start) else len(row)
        part = model["directions"][column[lo:hi]] * value[lo:hi, None]
        latent[row[start[a : a + 512]]] = np.add.reduceat(part, start[a : a + 512] - lo, axis=0)
    some = np.flatnonzero(np.linalg.norm(latent, axis=1) > 1e-6)
    latent = unit(latent)
    k = min(neighbours, len(model["labels"]))
    for a in range(0, len(some), 256):
        at = some[a : a + 256]
        cosine = latent[at] @ model["vectors"].T
        near = nearest(cosine, k)
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-3).astype(np.float64) ** SHARPNESS
        out[at] = (weight * model["labels"][near]).sum(1) / weight.sum(1)
    return np.clip(out, 0, 1)


def nearest(cosine: np.ndarray, k: int) -> np.ndarray:
    """Columns of each row's k largest values, of equal ones the first."""
    near = np.argpartition(cosine, -k, axis=1)[:, -k:]
    least = np.take_along_axis(cosine, near, 1).min(axis=1)
    # rows where the least of them stands more often than they hold
    for r in np.flatnonzero((cosine >= least[:, None]).sum(axis=1) > k):
        above = np.flatnonzero(cosine[r] > least[r])
        near[r] = np.r_[above, np.flatnonzero(cosine[r] == least[r])[: k - len(above)]]
    return near


def crc_mod(key: str, m: int):
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(m))


def train(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> dict:
    """The model, from at most sample labelled rows that are not held out."""
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_mod(key, 5) != 0))
    chosen = usable.groupBy(F.col(key).alias("key")).agg(F.min(label).cast("float").alias("label")).orderBy(F.xxhash64("key"), "key").limit(sample)
    # the sample's keys are few: they reach the documents as a filter, so no text is shuffled for rows outside it
    known = {r.key: r.label for r in chosen.collect()}
    if not known:
        return fit([])
    picked = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isin(list(known)))
    # one text for each key, however many rows have it
    picked = picked.groupBy("key").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = X.column_bytes(batch.column(1))
            for row, end, block, own in X.blocks(data, offsets):
                r, c, v = block_features(block, own)
                ends = np.cumsum(np.bincount(r, minlength=end - row))[:-1]
                packed = [pa.array([x.tobytes() for x in np.split(values, ends)], pa.binary()) for values in (c.astype(np.int32), v.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), *packed], names=["key", "c", "v"])

    # features come to the driver as bytes: as numbers of Python they take twenty times as much
    rows = sorted(picked.mapInArrow(run, f"key {documents.schema[key].dataType.simpleString()}, c binary, v binary").collect(), key=lambda r: r.key)
    return fit([(np.frombuffer(r.c, np.int32), np.frombuffer(r.v, np.float32), known[r.key]) for r in rows])


def score(documents: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = X.column_bytes(batch.column(1))
            for row, end, block, own in X.blocks(data, offsets):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, end - row), pa.array(score_block(block, own, shared.value))], names=["key", "score"])

    return source.mapInArrow(run, f"key {source.schema['key'].dataType.simpleString()}, score double").withColumnRenamed("key", key)


def keep_good(documents: DataFrame, model: dict, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of documents, with their own columns, whose score reaches threshold."""
    shared, at = documents.sparkSession.sparkContext.broadcast(model), documents.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = X.column_bytes(batch.column(at))
            scores = [score_block(block, own, shared.value) for _, _, block, own in X.blocks(data, offsets)]
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold)) if scores else batch

    return documents.mapInArrow(run, documents.schema)


def op7_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(documents, read_table(spark, sf_dir, "labels"))
    out = score(documents, model)
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
