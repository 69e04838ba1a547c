"""Operator 8: removal of repeated byte strings with suffix arrays built by induced sorting.

Every string of LENGTH bytes holds an anchor: the place of its smallest hash of GRAM bytes (leftmost of equal ones), which depends on the string
alone, so equal strings have equal anchors at equal places.  An anchor's context is the bytes of all strings that may hold it.

1. Anchors are compared by (anchor hash, context hash), in buckets of both, so a bucket's size does not depend on any anchor's contexts.  A context that
   occurs earlier is a repeat as a whole.  In a unit of the input only the first of equal contexts is sent on, so what meets in one task grows with
   the number of units, not with the copies.  Each bucket then asks how many contexts its anchors have in all: its own counts go to buckets of anchors, are
   added up there, and come back.
2. Where one anchor has several contexts, the first occurrence of each goes to the anchor's shard, where the sides that no other context shares are cut off
   (shared_sides).  The shard's suffix array is built by induced sorting, and
   permuted common prefixes of LENGTH bytes and more join neighbours to runs of equal strings; all but the earliest of a run are repeats.  An
   anchor with more than MOST_CONTEXTS contexts (the edge of a passage that very many texts share) would make one shard too large: its strings are
   dealt one by one, by their hashes, after equal ones of a batch have been settled there.
3. Repeats are united by document and cut out.

Order: documents by key (null first), then by a hash of the text; in a document by start.  Matches lie inside documents and are judged on the
input.  Rows with the same key and text are one document, and each gets its result.  Null and empty texts have nothing to remove.  Keys are cast to long.
Other columns are ignored.  Whole texts are used, none is cut; memory follows the longest text.  Contexts are compared by 64-bit hashes that mix all their
bytes, strings in shards byte by byte.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm import textops as X
from reedbank.llm.shared import parts_for, read_table, small_batches, written
from reedbank.llm.suffix_sort import permuted_lcp, suffix_array

LENGTH, GRAM = 100, 32
UNIT_BYTES = 12 << 20
SHARD_BYTES = 1 << 20
MOST_CONTEXTS = 50_000
#: A document's mark is a hash of 62 bits, and this bit where its key isn't null, so that null keys come first among equal ones.
HAS_KEY = 1 << 62


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM):
    """(row, place in the block, anchor hash, bytes of context to the left, to the right, context hash) of a block's anchors."""
    width = length - gram + 1
    n = len(data) - length + 1
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if n <= 0 or not (sizes >= length).any():
        return none, none, none.astype(np.uint64), none, none, none.astype(np.uint64)
    hashes = X.ByteHashes(data)
    at = np.arange(len(data) - gram + 1)
    grams = hashes.ranges(at, at + gram)
    bits = np.uint64(32)
    # the upper half of the hash, and the place below it: the smallest value tells the leftmost place of the smallest hash
    low = X.sliding_min((grams >> bits << bits) | at.astype(np.uint64), width)
    inside = np.repeat(sizes >= length, sizes)[:n]
    ends = offsets[1:][sizes >= length]
    # the last length - 1 starts of a row have no whole string
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, np.maximum(ends - length + 1, 0), 1)
    np.add.at(change, ends, -1)
    inside &= np.cumsum(change)[:n] == 0
    chosen = low[inside] & ((np.uint64(1) << bits) - np.uint64(1))
    place = chosen[np.r_[True, chosen[1:] != chosen[:-1]]].astype(np.int64) if len(chosen) else none
    place = np.unique(place)
    row = np.searchsorted(offsets, place, side="right") - 1
    left = np.minimum(length - gram, place - offsets[row])
    right = np.minimum(length, offsets[row + 1] - place)
    with np.errstate(over="ignore"):
        context = X.mix64(X.mixed_ranges(data, place - left, place + right) + left.astype(np.uint64) * X._GOLD)
    return row, place, grams[place], left, right, context


KINDS = "doc bigint, mark bigint, start int, left short, right short, anchor bigint, is_hot boolean"


def _places(doc: np.ndarray, mark: np.ndarray, start: np.ndarray, anchor: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Order by anchor, context and place, each place once: a repeated row names its places again, which makes them no repeats."""
    order = np.lexsort((start, mark, doc, context, anchor))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for x in (start, mark, doc, context, anchor):
        new[1:] |= x[order[1:]] != x[order[:-1]]
    return order[new]


def _contexts(source: DataFrame, buckets: int) -> DataFrame:
    """Anchors by bucket of (anchor, context), one for each of these of a unit; bucket -1 - b has the other ones, which are repeats."""

    def run(batches):
        import pyarrow as pa

        names = ["doc", "mark", "start", "left", "right", "anchor", "context"]
        waiting, held = [], 0

        def unit():
            doc, mark, start, left, right, anchor, context = (np.concatenate([x[i] for x in waiting]) for i in range(7))
            order = _places(doc, mark, start, anchor, context)
            doc, mark, start, left, right, anchor, context = (x[order] for x in (doc, mark, start, left, right, anchor, context))
            with np.errstate(over="ignore"):
                bucket = (X.mix64(anchor * X._GOLD + context) % np.uint64(buckets)).astype(np.int64)
            first = np.ones(len(anchor), bool)
            first[1:] = (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])
            # repeats of a unit only need a task of their own
            bucket[~first] = -1 - (mark[~first] % buckets)
            order = np.lexsort((start, mark, doc, bucket))
            cut = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1]]) if len(order) else np.zeros(0, np.int64)
            columns = [doc, mark, start.astype(np.int32), left.astype(np.int16), right.astype(np.int16), anchor, context]
            blobs = [[x[order[p:q]].tobytes() for p, q in zip(cut, np.r_[cut[1:], len(order)], strict=True)] for x in columns]
            return pa.RecordBatch.from_arrays([pa.array(bucket[order[cut]] if len(cut) else cut, pa.int32()), *[pa.array(x, pa.binary()) for x in blobs]], names=["bucket", *names])

        for batch in batches:
            data, offsets = X.column_bytes(batch.column(2))
            doc, mark = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            for row, _, block, own in X.blocks(data, offsets):
                r, place, anchor, left, right, context = anchors(block, own)
                if len(r):
                    waiting.append((doc[row + r], mark[row + r], place - own[r], left, right, anchor, context))
                held += len(block)
                if held >= UNIT_BYTES and waiting:
                    yield unit()
                    waiting, held = [], 0
        if waiting:
            yield unit()

    return source.mapInArrow(run, "bucket int, doc binary, mark binary, start binary, left binary, right binary, anchor binary, context binary")


FIELDS = {"doc": np.int64, "mark": np.int64, "start": np.int32, "left": np.int16, "right": np.int16, "anchor": np.uint64, "context": np.uint64}


def _bucket(table) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """A bucket's anchors in order, which of them are the first of their context, the distinct anchors and how many contexts each has here."""
    x = {k: np.concatenate([np.frombuffer(b.as_buffer(), t) for b in table.column(k)]) for k, t in FIELDS.items()}
    order = _places(*(x[k] for k in ("doc", "mark", "start", "anchor", "context")))
    x = {k: v[order] for k, v in x.items()}
    new = np.r_[True, x["anchor"][1:] != x["anchor"][:-1]]
    first = new | np.r_[True, x["context"][1:] != x["context"][:-1]]
    at = np.flatnonzero(new)
    return x, first, x["anchor"][at], np.add.reduceat(first.astype(np.uint32), at, dtype=np.uint32)


COUNTS = "place int, bucket int, anchors binary, times binary"


def _asked(contexts: DataFrame, buckets: int) -> DataFrame:
    """A bucket's distinct anchors and their numbers of contexts, by place: the bucket of the anchor alone."""

    def run(table):
        import pyarrow as pa

        bucket, rows = table.column("bucket")[0].as_py(), []
        if bucket >= 0:
            _, _, anchor, times = _bucket(table)
            place = (anchor % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[order], np.arange(buckets + 1))
            rows = [(int(p), bucket, anchor[order[cut[p] : cut[p + 1]]].tobytes(), times[order[cut[p] : cut[p + 1]]].tobytes()) for p in np.flatnonzero(np.diff(cut))]
        kinds = {"place": pa.int32(), "bucket": pa.int32(), "anchors": pa.binary(), "times": pa.binary()}
        return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})

    return contexts.groupBy("bucket").applyInArrow(run, COUNTS)


def _answered(asked: DataFrame) -> DataFrame:
    """The anchors' numbers of contexts in all buckets, to each bucket that asked."""

    def run(table):
        import pyarrow as pa

        anchors = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("anchors")]
        every, back = np.unique(np.concatenate(anchors), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([np.frombuffer(b.as_buffer(), np.uint32) for b in table.column("times")])).astype(np.uint32)
        ends = np.cumsum([len(a) for a in anchors])
        return pa.table({k: table.column(k) for k in ("bucket", "place")} | {"times": pa.array([total[back[z - len(a) : z]].tobytes() for a, z in zip(anchors, ends, strict=True)], pa.binary())})

    return asked.groupBy("place").applyInArrow(run, "bucket int, place int, times binary")


def _sources(contexts: DataFrame, buckets: int) -> DataFrame:
    """Repeats as a whole (anchor null), and first occurrences of contexts whose anchor has several ones."""

    def run(table, answers):
        import pyarrow as pa

        if table.num_rows and table.column("bucket")[0].as_py() < 0:
            x = {k: np.concatenate([np.frombuffer(b.as_buffer(), t) for b in table.column(k)]) for k, t in FIELDS.items()}
            use, ask = np.ones(len(x["doc"]), bool), np.zeros(len(x["doc"]), bool)
            hot = ask
        else:
            x, first, anchor, own = _bucket(table)
            place = (anchor % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(place, kind="stable")
            cut = np.searchsorted(place[order], np.arange(buckets + 1))
            total = np.zeros(len(anchor), np.int64)
            for p, times in zip(answers.column("place").to_pylist(), answers.column("times"), strict=True):
                total[order[cut[p] : cut[p + 1]]] = np.frombuffer(times.as_buffer(), np.uint32)
            contexts_of = np.repeat(total, np.diff(np.r_[np.flatnonzero(np.r_[True, x["anchor"][1:] != x["anchor"][:-1]]), len(first)]))
            use, ask, hot = ~first | (contexts_of > 1), first, contexts_of > MOST_CONTEXTS
        out = {k: pa.array(x[k][use]) for k in ("doc", "mark", "start", "left", "right")}
        return pa.table(out | {"anchor": pa.array(x["anchor"][use].view(np.int64), mask=~ask[use]), "is_hot": pa.array(hot[use])})

    answers = _answered(_asked(contexts, buckets))
    return contexts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(run, KINDS)


def shared_sides(data: np.ndarray, offsets: np.ndarray, left: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """The stretch of each piece in which strings of length may be found in another one.

    Such a string holds the anchor's gram and reaches half of the rest at least to its left or to its right.  Where no other piece has the gram with the same half to
    the left, only strings that reach further to the right come into question, and the other way round; a piece that shares neither half holds none."""
    half, at, sizes = (length - gram) // 2, offsets[:-1] + left, np.diff(offsets)

    def is_shared(valid, start, end):
        found = np.zeros(len(left), bool)
        some = np.flatnonzero(valid)
        _, back, times = np.unique(X.mixed_ranges(data, start[some], end[some]), return_inverse=True, return_counts=True)
        found[some] = times[back] > 1
        return found

    to_left = is_shared(left >= half, at - half, at + gram)
    to_right = is_shared(sizes - left >= gram + half, at, at + gram + half)
    begin = np.where(to_left, 0, np.maximum(0, left - half))
    end = np.where(to_right, sizes, np.minimum(sizes, left + gram + half))
    return begin, np.where(to_left | to_right, end, begin)


def _shard_repeats(pieces: DataFrame, length: int) -> DataFrame:
    """(doc, mark, start, end) of strings that start earlier in the shard; pieces: (shard, doc, mark, start, left, bytes), left: where the anchor's gram stands."""

    def run(table):
        import pyarrow as pa

        doc, mark, start = (table.column(c).to_numpy() for c in ("doc", "mark", "start"))
        raw = table.column("bytes").combine_chunks()
        data, offsets = X.column_bytes(raw)
        begin, end = shared_sides(data, offsets, table.column("left").to_numpy().astype(np.int64), length)
        some = np.flatnonzero(end - begin >= length)
        doc, mark, start, sizes = doc[some], mark[some], start[some] + begin[some], (end - begin)[some]
        # a separator behind each piece; bytes move up by one, texts use none above 0xF4
        moved = (data + np.uint8(1)).tobytes()
        first = offsets[some] + begin[some]
        text = np.frombuffer(b"".join([moved[p:z] + b"\0" for p, z in zip(first.tolist(), (first + sizes).tolist(), strict=True)]), np.uint8)
        del raw, data, moved
        offsets = np.r_[0, np.cumsum(sizes)]
        begin = offsets[:-1] + np.arange(len(sizes))
        order = suffix_array(text, 256)
        # lengths matter inside a piece only, so they are counted anew where one begins
        joined = permuted_lcp(text, order, length + int(sizes.max(initial=0)), begin)[order] >= length
        # strings that run over the end of their piece hold a separator; they are left out
        follows = np.r_[joined[1:], False]
        kept = order[joined | follows]
        group = np.cumsum(~joined[joined | follows]) - 1
        owner = np.searchsorted(begin, kept, side="right") - 1
        place = kept - begin[owner]
        whole = place + length <= sizes[owner]
        kept, group, owner, place = kept[whole], group[whole], owner[whole], place[whole]
        # one number for a document and a place in it
        documents, number = np.unique(np.rec.fromarrays([doc, mark], names="d,m"), return_inverse=True)
        key = (number[owner].astype(np.int64) << 40) | (start[owner].astype(np.int64) + place)
        least = np.full(int(group.max(initial=-1)) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, key)
        # unite neighbouring starts
        key = np.unique(key[key > least[group]])
        a = np.flatnonzero(np.r_[True, key[1:] != key[:-1] + 1]) if len(key) else np.zeros(0, np.int64)
        z = np.r_[a[1:], len(key)] - 1 if len(a) else a
        low = (1 << 40) - 1
        which = documents[key[a] >> 40]
        return pa.table({"doc": pa.array(np.asarray(which.d)), "mark": pa.array(np.asarray(which.m)), "start": pa.array(key[a] & low), "end": pa.array((key[z] & low) + length)})

    return pieces.groupBy("shard").applyInArrow(run, "doc bigint, mark bigint, start bigint, end bigint")


def _string_repeats(once: DataFrame, length: int) -> DataFrame:
    """(doc, mark, start, end) of strings of hot contexts that start earlier; once: (doc, mark, text, asked)."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            doc, mark = (batch.column(i).to_numpy() for i in range(2))
            data, offsets = X.column_bytes(batch.column(2))
            flat, bounds = batch.column(3).flatten(), np.asarray(batch.column(3).offsets)
            start, left, right = (flat.field(i).to_numpy().astype(np.int64) for i in range(3))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            n = np.maximum(left + right - length + 1, 0)
            owner = np.repeat(row, n)
            first = np.repeat(start - left, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            h = X.mixed_ranges(data, offsets[owner] + first, offsets[owner] + first + length)
            order = np.lexsort((first, mark[owner], doc[owner], h))
            h, owner, first = h[order], owner[order], first[order]
            # the same string of one document may stand in two contexts
            same = np.r_[False, (h[1:] == h[:-1]) & (owner[1:] == owner[:-1]) & (first[1:] == first[:-1])] if len(h) else np.zeros(0, bool)
            h, owner, first = h[~same], owner[~same], first[~same]
            again = np.r_[False, h[1:] == h[:-1]] if len(h) else np.zeros(0, bool)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(doc[owner]), pa.array(mark[owner]), pa.array(first), pa.array(again)], names=["h", "doc", "mark", "start", "again"])

    strings = once.select("doc", "mark", "text", "asked").mapInArrow(run, "h bigint, doc bigint, mark bigint, start bigint, again boolean")
    strings = written(strings, "op8_strings")
    place = F.struct("doc", "mark", "start")
    firsts = strings.where("not again")
    least = firsts.groupBy("h").agg(F.min(place).alias("least"))
    later = firsts.join(least, "h").where(place != F.col("least")).select("doc", "mark", "start")
    repeats = later.unionByName(strings.where("again").select("doc", "mark", "start"))
    return repeats.select("doc", "mark", "start", (F.col("start") + length).alias("end"))


def remove_repeats(documents: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(key, n_bytes, spans, kept): spans are the removed stretches [start, end) in bytes, kept the rest."""
    small_batches(documents.sparkSession)
    number, content = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit(""))
    mark = F.xxhash64(content).bitwiseAND(F.lit(HAS_KEY - 1)) + F.when(number.isNull(), F.lit(0)).otherwise(F.lit(HAS_KEY))
    source = documents.select(F.coalesce(number, F.lit(-(1 << 63))).alias("doc"), mark.alias("mark"), content.alias("text"))
    buckets = parts_for(documents, text, 4 << 20, 12)
    marks = written(_sources(_contexts(source, buckets), buckets), "op8_marks")
    wanted = marks.where("anchor is not null")
    ask = F.struct("start", "left", "right", "anchor")
    asked = wanted.groupBy("doc", "mark").agg(F.collect_list(F.when(~F.col("is_hot"), ask)).alias("asked"), F.collect_list(F.when(F.col("is_hot"), ask)).alias("hot"))
    shards = int(max(12, wanted.agg(F.coalesce(F.sum(F.col("left") + F.col("right")), F.lit(0))).first()[0] // SHARD_BYTES))

    def pieces(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = X.column_bytes(batch.column(2))
            asked_of = batch.column(3)
            doc, mark = (batch.column(i).to_numpy() for i in range(2))
            flat, bounds = asked_of.flatten(), np.asarray(asked_of.offsets)
            start, left, right, anchor = (flat.field(i).to_numpy().astype(np.int64) for i in range(4))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            base = offsets[row] + start
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((anchor.view(np.uint64) % np.uint64(shards)).astype(np.int32)),
                    pa.array(doc[row]),
                    pa.array(mark[row]),
                    pa.array(start - left),
                    pa.array(left),
                    pa.array([raw[a:b] for a, b in zip((base - left).tolist(), (base + right).tolist(), strict=True)], pa.binary()),
                ],
                names=["shard", "doc", "mark", "start", "left", "bytes"],
            )

    # rows with the same key and text are one document
    once = source.join(asked, ["doc", "mark"]).select("doc", "mark", "text", "asked", "hot").dropDuplicates(["doc", "mark"])
    parts = once.select("doc", "mark", "text", "asked").mapInArrow(pieces, "shard int, doc bigint, mark bigint, start bigint, left bigint, bytes binary")
    found = written(_shard_repeats(parts, length), "op8_found")
    if wanted.where("is_hot").take(1):
        hot = once.where(F.size("hot") > 0).select("doc", "mark", "text", F.col("hot").alias("asked"))
        found = found.unionByName(_string_repeats(hot, length))
    whole = marks.where("anchor is null").select("doc", "mark", (F.col("start") - F.col("left")).cast("long").alias("start"), (F.col("start") + F.col("right")).cast("long").alias("end"))
    whole = whole.where(F.col("end") - F.col("start") >= length)
    cuts = whole.unionByName(found).groupBy("doc", "mark").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("cuts"))

    def cut(batches):
        import pyarrow as pa

        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                data, offsets = X.column_bytes(part.column(1))
                raw = data.tobytes()
                spans_out, kept = [], []
                for r, cuts_of in enumerate(part.column(2).to_pylist()):
                    own = raw[offsets[r] : offsets[r + 1]]
                    if not cuts_of:
                        spans_out.append([])
                        kept.append(own)
                        continue
                    spans: list[list[int]] = []
                    for c in cuts_of:
                        if spans and c["start"] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], c["end"])
                        else:
                            spans.append([c["start"], c["end"]])
                    edges = [0, *[e for s in spans for e in s], len(own)]
                    kept.append(b"".join(own[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                    spans_out.append([{"start": s, "end": e} for s, e in spans])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(offsets)), pa.array(spans_out, span), pa.array(kept, pa.binary())], names=["doc", "n_bytes", "spans", "kept"]
                )

    out = source.join(cuts, ["doc", "mark"], "left").select(F.when(F.col("mark") >= HAS_KEY, F.col("doc")).alias("doc"), "text", "cuts").mapInArrow(cut, "doc bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return out.select(F.col("doc").alias(key), "n_bytes", "spans", "kept")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read_table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
