"""Operator 4: benchmark decontamination by winnowing.

Words of benchmark items and of documents are hashed.  Of each window of consecutive k-grams only the smallest hash is
kept, so any shared run of at least span words shares a kept k-gram: with k-grams of 5 words and spans of 10, the windows
hold 6 k-grams.  Document fingerprints are looked up among the items' fingerprints; each hit is extended to all runs of span words around it, and
those that are an item's window make their words hit.  Items with fewer words than span are one window each, looked up at their own length.

The items' index is broadcast in chunks of at most CHUNK_ITEMS_BYTES of text; one chunk is the usual case, and more chunks are as many
passes whose spans are united by document, so the size of the benchmark is not limited by an executor's memory.

Rows: null and empty texts have no words.  Items without words are never found; a null item_id is written as 'null'.  Repeated item ids count once.
A null doc_id is kept; with more than one chunk, repeated doc_ids with different texts stay apart by the text's hash.
Other columns are ignored.  Texts are never cut: memory follows the longest one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm import textops as X
from reedbank.llm.shared import read_table, written

SPAN, GRAM = 10, 5
CHUNK_ITEMS_BYTES = 32 << 20


def build_index(items: list[tuple[str, str]], span: int = SPAN, gram: int = GRAM) -> dict:
    """items: (id, text).  Sorted fingerprints; by window length, sorted window hashes with the items that have them."""
    raw = [t.encode("utf-8", "surrogatepass") for _, t in items]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) for r in raw], out=offsets[1:])
    words = X.Words(np.frombuffer(b"".join(raw), np.uint8), offsets, X.ALNUM)
    found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    prints = [np.zeros(0, np.uint64)]
    for row, n in enumerate(words.counts):
        if not n:
            continue
        h = words.hash[words.first[row] : words.first[row + 1]]
        size = min(span, int(n))
        runs = X.run_hashes(h, size)
        found.setdefault(size, []).append((runs, np.full(len(runs), row)))
        if size == span:
            prints.append(X.sliding_min(X.run_hashes(h, gram), span - gram + 1))
    windows = {}
    for size, parts in found.items():
        pairs = np.unique(np.rec.fromarrays([np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])], names="h,i"))
        hashes, start = np.unique(pairs.h, return_index=True)
        windows[size] = (hashes, np.append(start, len(pairs)), np.asarray(pairs.i, dtype=np.int64))
    return {"ids": [i for i, _ in items], "prints": np.unique(np.concatenate(prints)), "windows": windows, "span": span, "gram": gram}


def _lookup(table: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in values that are in the sorted table, and their places there."""
    if not len(table) or not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # a bit map over 22 bits of the hash drops almost all misses before the binary search
    bits = np.zeros(1 << 22, dtype=bool)
    bits[(table >> np.uint64(42)).astype(np.int64)] = True
    at = np.flatnonzero(bits[(values >> np.uint64(42)).astype(np.int64)])
    place = np.minimum(np.searchsorted(table, values[at]), len(table) - 1)
    same = table[place] == values[at]
    return at[same], place[same]


def find_spans(words: X.Words, index: dict) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, first words of windows that occur, their places among the index's windows of that length)."""
    out, h = [], words.hash
    for size, (hashes, _, _) in index["windows"].items():
        if len(h) < size:
            continue
        if size < index["span"]:
            at, place = _lookup(hashes, X.run_hashes(h, size))
        else:
            grams = X.run_hashes(h, index["gram"])
            width = size - index["gram"] + 1
            if len(grams) < width:
                continue
            low = X.sliding_min(grams, width)
            # a gram is kept if it is the smallest of some window that holds it
            kept = np.zeros(len(grams), dtype=bool)
            for back in range(width):
                kept[back : back + len(low)] |= grams[back : back + len(low)] == low
            kept = np.flatnonzero(kept)
            hit, _ = _lookup(index["prints"], grams[kept])
            begin = (kept[hit][:, None] - np.arange(width)[None, :]).ravel()
            begin = np.unique(begin[(begin >= 0) & (begin + size <= len(h))])
            if not len(begin):
                continue
            with np.errstate(over="ignore"):
                runs = np.full(len(begin), np.uint64(size) * X._GOLD, dtype=np.uint64)
                for j in range(size):
                    runs += h[begin + j] * X._RUN_FACTORS[j]
            hit, place = _lookup(hashes, X.mix64(runs))
            at = begin[hit]
        if len(at):
            # windows lie in one row
            row = np.searchsorted(words.first, at, side="right") - 1
            inside = at + size <= words.first[row + 1]
            at, place = at[inside], place[inside]
        if len(at):
            out.append((size, at, place))
    return out


def _spans_of_rows(words: X.Words, index: dict) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
    """By row with hits: spans of words [start, end) in the row, united, and item ids."""
    rows: dict[int, tuple[list, set]] = {}
    for size, at, place in find_spans(words, index):
        _, start, items = index["windows"][size]
        row = np.searchsorted(words.first, at, side="right") - 1
        for r, s, p in zip(row.tolist(), at.tolist(), place.tolist(), strict=True):
            spans, ids = rows.setdefault(r, ([], set()))
            s -= int(words.first[r])
            spans.append((s, s + size))
            ids.update(index["ids"][i] for i in items[start[p] : start[p + 1]].tolist())
    return {r: (unite(spans), ids) for r, (spans, ids) in rows.items()}


def unite(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def items_of(benchmark: DataFrame, item: str, item_text: str) -> DataFrame:
    return benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("null")).alias("id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("t"))


def chunks_of(items: DataFrame) -> int:
    return int(items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0] // CHUNK_ITEMS_BYTES) + 1


def index_of_chunk(items: DataFrame, chunk: int, n_chunks: int, span: int, gram: int) -> dict:
    part = items if n_chunks == 1 else items.where(F.pmod(F.xxhash64("t"), F.lit(n_chunks)) == chunk)
    return build_index([(r.id, r.t) for r in part.toLocalIterator()], span, gram)


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The rows of documents, with their own columns, that no item's window occurs in."""
    items = items_of(benchmark, item, item_text)
    n_chunks, names, out = chunks_of(items), documents.columns, documents
    for chunk in range(n_chunks):
        shared = documents.sparkSession.sparkContext.broadcast(index_of_chunk(items, chunk, n_chunks, span, gram))

        def run(batches, shared=shared):
            import pyarrow as pa

            at = names.index(text)
            for batch in batches:
                data, offsets = X.column_bytes(batch.column(at))
                clean = np.ones(batch.num_rows, bool)
                for row, _, block, own in X.blocks(data, offsets):
                    words = X.Words(block, own, X.ALNUM)
                    for _, first, _ in find_spans(words, shared.value):
                        clean[row + np.searchsorted(words.first, first, side="right") - 1] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(run, documents.schema)
        if chunk + 1 < n_chunks:
            # so that no task holds two chunks' indexes
            out = written(out, "op4_left")
    return out


RESULT = "n_words bigint, hits array<struct<start:bigint,end:bigint>>, items array<string>"


def contaminated_spans(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, n_words, hits, items) for each document: hit spans of word numbers [start, end), and the items' ids, sorted as strings."""
    spark = documents.sparkSession
    key_type = documents.schema[key].dataType.simpleString()
    one = items_of(benchmark, item, item_text)
    n_chunks = chunks_of(one)
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def pass_over(chunk: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(index_of_chunk(one, chunk, n_chunks, span, gram))

        def run(batches):
            import pyarrow as pa

            index = shared.value
            hit_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            for batch in batches:
                data, offsets = X.column_bytes(batch.column(1))
                for row, end, block, own in X.blocks(data, offsets):
                    words = X.Words(block, own, X.ALNUM)
                    found = _spans_of_rows(words, index)
                    none: tuple[list, set] = ([], set())
                    hits = [[{"start": s, "end": e} for s, e in found.get(r, none)[0]] for r in range(end - row)]
                    ids = [sorted(found.get(r, none)[1]) for r in range(end - row)]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(row, end - row), pa.array(words.counts.astype(np.int64)), pa.array(hits, hit_type), pa.array(ids, pa.list_(pa.string()))]
                        + ([batch.column(2).slice(row, end - row)] if batch.num_columns > 2 else []),
                        names=["key", "n_words", "hits", "items"] + ["mark"] * (batch.num_columns > 2),
                    )

        return (source if n_chunks == 1 else source.withColumn("mark", F.xxhash64("text"))).mapInArrow(run, f"key {key_type}, {RESULT}" + ", mark bigint" * (n_chunks > 1))

    if n_chunks == 1:
        return pass_over(0).withColumnRenamed("key", key)
    out = None
    for chunk in range(n_chunks):
        got = written(pass_over(chunk), "op4_chunk")
        out = got if out is None else out.unionByName(got)
    # repeated rows have equal results in each chunk: their number is the count of one chunk's rows
    whole = out.groupBy("key", "mark").agg(
        F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"), F.count("*").alias("n")
    )
    joined = F.aggregate(
        "hits",
        F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"),
        lambda a, x: F.when((F.size(a) > 0) & (F.element_at(a, -1)["end"] >= x["start"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.element_at(a, -1)["start"].alias("start"), F.greatest(F.element_at(a, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(a, F.array(x))),
    )
    return whole.select(F.col("key").alias(key), "n_words", joined.alias("hits"), "items", F.explode(F.sequence(F.lit(1), (F.col("n") / n_chunks).cast("int"))).alias("copy")).drop("copy")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated_spans(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )
