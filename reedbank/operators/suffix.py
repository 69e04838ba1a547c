"""Suffix order of sequences as a table: patterns of any length are counted and located by ranges.

The table has a row for each place of each sequence: the next WIDTH letters, sorted by range, so that a pattern's places are one stretch of it.  Equal stretches are told apart by
place, so the order can be cut anywhere and a stretch that many sequences share is spread over parts.  A search sorts the patterns' first WIDTH letters in among the places,
where each stands right before its stretch, and passes over the parts once, a block of rows at a time: a pattern is open until letters come that it doesn't begin.  What is open where a part begins are
beginnings of the part's first letters, so at most WIDTH a part are broadcast, however many patterns there are.  Patterns longer than WIDTH are found by their first letters, and
their few candidates are held against the sequences.

Rows of one id must have one sequence; repeated rows have their places as often, and are one row where rows are counted.

What is asked decides what leaves a pass: counts, first places and numbers of rows are summed up by block, and a place comes out once, with the lengths of all patterns that it begins."""

from __future__ import annotations

from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reedbank.session import cut, meet, spread

WIDTH = 32
#: Rows (places and patterns) of a sorted part that are searched at a time.
BLOCK_PATTERNS = 1 << 18
#: Places of sequences that are held against each other at a time; one sequence at least.
PLACES = 1 << 18
#: Offsets of the rows that stand for patterns: whole ones, and first letters of longer ones.
SHORT, LONG = 0, -1


def ungapped(msa: DataFrame, seq_id: str = "id", aligned: str = "aln") -> DataFrame:
    """(id, seq, columns): each row's bases and the 1-based columns that they stand in."""
    sites = F.transform(F.split(F.upper(F.col(aligned)), ""), lambda b, i: F.struct((i + 1).alias("c"), b.alias("b")))
    kept = spread(msa).select(F.col(seq_id).alias("id"), F.filter(sites, lambda s: s["b"].isin("A", "C", "G", "T")).alias("s"))
    return kept.select("id", F.array_join(F.transform("s", lambda s: s["b"]), "").alias("seq"), F.transform("s", lambda s: s["c"]).alias("columns"))


def places(seqs: DataFrame, width: int = WIDTH, seq_id: str = "id", seq: str = "seq") -> DataFrame:
    """(letters, id, offset): every place (1-based) of every sequence with what follows, in no order."""
    at = F.when(F.length(seq) > 0, F.sequence(F.lit(1), F.length(seq)))
    rows = seqs.select(F.col(seq_id).alias("id"), F.col(seq).alias("seq"), F.explode(at).alias("offset"))
    return rows.select(F.substring("seq", F.col("offset"), F.lit(width)).alias("letters"), "id", "offset")


def _in_order(rows: DataFrame) -> DataFrame:
    return cut(rows.repartitionByRange("letters", "id", "offset").sortWithinPartitions("letters", "id", "offset"))


def order(seqs: DataFrame, width: int = WIDTH, seq_id: str = "id", seq: str = "seq") -> DataFrame:
    """(letters, id, offset): the places in order."""
    return _in_order(places(seqs, width, seq_id, seq))


def _windows(lengths: np.ndarray, data: np.ndarray, width: int) -> np.ndarray:
    """The next width letters of each place of texts that lie one behind the other; zeros beyond a text's end."""
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))
    padded = np.r_[data, np.zeros(width, np.uint8)]
    letters = np.lib.stride_tricks.sliding_window_view(padded, width)[: len(data)].copy()
    letters[np.arange(width) >= left[:, None]] = 0
    return letters


def _seen(letters: np.ndarray, row: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """How many of each place's first letters stand at an earlier place of its row too."""
    n, width = letters.shape
    wide = np.zeros((n, -(-width // 8) * 8), np.uint8)
    wide[:, :width] = letters
    keys = wide.view(">u8").astype(np.uint64)
    by = np.lexsort((*keys.T[::-1], row))
    letters, row, offset = letters[by], row[by], offset[by]
    same = (letters[1:] == letters[:-1]) & (letters[1:] != 0) & (row[1:] == row[:-1])[:, None]
    common = np.r_[0, np.logical_and.accumulate(same, axis=1).sum(1)]
    seen = np.zeros(n, np.int32)
    for k in range(1, int(common.max(initial=0)) + 1):
        starts = np.flatnonzero(common < k)
        earliest = np.repeat(np.minimum.reduceat(offset, starts), np.diff(np.r_[starts, n]))
        seen += offset > earliest
    out = np.empty(n, np.int32)
    out[by] = seen
    return out


def _strings(letters: np.ndarray):
    """An Arrow array of the texts in the rows of a matrix that zeros fill up."""
    import pyarrow as pa

    some = letters != 0
    ends = np.r_[0, np.cumsum(some.sum(1))].astype(np.int32)
    return pa.StringArray.from_buffers(len(letters), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(letters[some])))


def places_seen(seqs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(letters, id, offset, seen) of sequences (id, seq): the places, and how many of the letters stand at an earlier place of the same sequence too."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            ids, texts = batch.column(0), [(x or "").encode() for x in batch.column(1).to_pylist()]
            lengths = np.array([len(x) for x in texts], np.int64)
            part = np.cumsum(lengths) // PLACES
            for k in np.unique(part):
                a, b = np.searchsorted(part, [k, k + 1])
                mine = lengths[a:b]
                if not mine.sum():
                    continue
                letters = _windows(mine, np.frombuffer(b"".join(texts[a:b]), np.uint8), width)
                row = np.repeat(np.arange(b - a), mine)
                offset = (np.arange(len(row)) - np.repeat(np.cumsum(mine) - mine, mine) + 1).astype(np.int32)
                arrays = [_strings(letters), ids.take(pa.array(row + a)), pa.array(offset), pa.array(_seen(letters, row, offset))]
                yield pa.RecordBatch.from_arrays(arrays, names=["letters", "id", "offset", "seen"])

    kind = seqs.schema["id"].dataType.simpleString()
    return seqs.select("id", "seq").mapInArrow(run, f"letters string, id {kind}, offset int, seen int")


class Block:
    """Sorted rows, and the stretches of the patterns that are open in them: what (pattern), begin and end."""

    def __init__(self, batch, width: int):
        self.batch = batch
        self.letters = _fixed(batch.column(0), width)
        self.offset = batch.column(2).to_numpy()
        self.real = self.offset > SHORT

    def open(self, carried: list[bytes], which: int) -> list[bytes]:
        """Takes the patterns that are open before and those that stand among the rows; those that are open beyond."""
        n = len(self.letters)
        at = np.flatnonzero(self.offset == which)
        self.what = np.r_[np.array(carried, self.letters.dtype), self.letters[at]]
        self.begin = np.r_[np.zeros(len(carried), np.int64), at]
        self.size = np.char.str_len(self.what)
        # beyond every continuation of the pattern
        beyond = np.char.add(self.what, b"\x7f")
        self.end = np.searchsorted(self.letters.astype(beyond.dtype), beyond, "left")
        return [bytes(p) for p in self.what[self.end == n]]

    def per_pattern(self, rows: np.ndarray) -> np.ndarray:
        """How many of the marked rows each pattern's stretch has."""
        upto = np.r_[0, np.cumsum(rows)]
        return upto[self.end] - upto[self.begin]

    def depths(self):
        """(length, whether each row begins with an open pattern of that length); stretches of one length don't meet."""
        for k in np.unique(self.size):
            step = np.zeros(len(self.letters) + 1, np.int32)
            mine = self.size == k
            np.add.at(step, self.begin[mine], 1)
            np.add.at(step, self.end[mine], -1)
            yield int(k), (np.cumsum(step[:-1]) > 0) & self.real


def _fixed(texts, width: int) -> np.ndarray:
    """An Arrow array of texts of at most width bytes as an array of that many bytes."""
    texts = texts.cast("string")
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    size, out = np.diff(ends), np.zeros((len(texts), width), np.uint8)
    if ends[-1] > ends[0]:
        out[np.arange(width) < size[:, None]] = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    return out.view(f"S{width}").ravel()


class Search:
    """Suffixes (letters, id, offset, any others; in any order) and patterns (a column pattern) in one order."""

    def __init__(self, suffixes: DataFrame, patterns: DataFrame, width: int):
        asked = patterns.where(F.length("pattern") > 0)
        kind = F.when(F.length("pattern") > width, LONG).otherwise(SHORT).alias("offset")
        marks = cut(asked.select(F.substring("pattern", 1, width).alias("letters"), kind).distinct())
        self.width, self.id_type = width, suffixes.schema["id"].dataType
        self.rows = _in_order(suffixes.unionByName(marks, allowMissingColumns=True))
        firsts = self.rows.select("letters").rdd.mapPartitions(lambda rows: islice(rows, 1)).collect()
        begun = {(r.letters[:k],) for r in firsts for k in range(1, len(r.letters) + 1)}
        shared = F.broadcast(suffixes.sparkSession.createDataFrame(sorted(begun), "letters string"))
        self.begun = {(r.letters.encode(), r.offset) for r in marks.join(shared, "letters").collect()}

    def over(self, which: int, make, schema: str) -> DataFrame:
        """make(block) of each block of rows, for the patterns of one kind."""
        width, size = self.width, BLOCK_PATTERNS
        begun = {p for p, kind in self.begun if kind == which}

        def run(batches):
            carried = None
            for batch in (b.slice(k, size) for b in batches for k in range(0, b.num_rows, size)):
                block = Block(batch, width)
                if carried is None:
                    first = bytes(block.letters[0])
                    # the pattern that is the first letters themselves may stand in this part
                    here = which in block.offset[:2][block.letters[:2] == first]
                    carried = [first[:k] for k in range(1, len(first) + 1) if first[:k] in begun and not (here and k == len(first))]
                carried = block.open(carried, which)
                yield from make(block)

        return self.rows.mapInArrow(run, schema)

    def long(self, patterns: DataFrame, seqs: DataFrame) -> DataFrame:
        """(pattern, offset and the columns of seqs) of the places of patterns longer than width."""

        def make(block):
            import pyarrow as pa

            at = np.zeros(len(block.real), bool)
            for _, some in block.depths():
                at |= some
            yield block.batch.select([0, 1, 2]).filter(pa.array(at)).rename_columns(["head", "id", "offset"])

        long = patterns.where(F.length("pattern") > self.width).select("pattern").distinct().withColumn("head", F.substring("pattern", 1, self.width))
        found = meet(self.over(LONG, make, f"head string, id {self.id_type.simpleString()}, offset int"), long, "head")
        return meet(found, seqs.dropDuplicates(["id"]), "id").where(F.substring("seq", F.col("offset"), F.length("pattern")) == F.col("pattern")).drop("head")

    def short(self) -> DataFrame:
        """(letters, id, offset, lengths): each place that patterns of at most width letters begin, with their lengths."""

        def make(block):
            import pyarrow as pa

            depths = list(block.depths())
            if not depths:
                return
            at = np.stack([some for _, some in depths], 1)
            some = at.any(1)
            at = at[some]
            lengths = np.array([k for k, _ in depths], np.int16)[np.nonzero(at)[1]]
            ends = np.r_[0, np.cumsum(at.sum(1))].astype(np.int32)
            kept = block.batch.select([0, 1, 2]).filter(pa.array(some))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(lengths))], names=["letters", "id", "offset", "lengths"])

        return self.over(SHORT, make, f"letters string, id {self.id_type.simpleString()}, offset int, lengths array<smallint>")


def _patterns_of(what: np.ndarray):
    import pyarrow as pa

    return pa.array([p.decode() for p in what.tolist()], pa.string())


def _numbers(block: Block, n: np.ndarray):
    import pyarrow as pa

    some = n > 0
    yield pa.RecordBatch.from_arrays([_patterns_of(block.what[some]), pa.array(n[some], pa.int64())], names=["pattern", "n"])


def count(suffixes: DataFrame, patterns: DataFrame, seqs: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """(pattern, n) of each distinct pattern (a column pattern) that stands anywhere: at how many places.  seqs (id, seq) are needed for patterns longer than width."""
    search = Search(suffixes, patterns, width)
    out = search.over(SHORT, lambda block: _numbers(block, block.per_pattern(block.real)), "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n"))
    if seqs is None:
        return out
    return out.unionByName(search.long(patterns, seqs.select("id", "seq")).groupBy("pattern").agg(F.count("*").alias("n")))


def locate(suffixes: DataFrame, patterns: DataFrame, seqs: DataFrame | None = None, width: int = WIDTH) -> DataFrame:
    """(pattern, id, offset): all places of each distinct pattern.  seqs (id, seq) are needed for patterns longer than width."""
    search = Search(suffixes, patterns, width)
    out = search.short().withColumn("n", F.explode("lengths")).select(F.substring("letters", F.lit(1), F.col("n").cast("int")).alias("pattern"), "id", "offset")
    return out if seqs is None else out.unionByName(search.long(patterns, seqs.select("id", "seq")).select("pattern", "id", "offset"))


def locate_columns(suffixes: DataFrame, patterns: DataFrame, rows: DataFrame, width: int = WIDTH) -> DataFrame:
    """(pattern, id, start, end): the columns of all places of each distinct pattern, by the rows (id, seq, columns).  Places meet rows before they are widened to patterns."""
    search = Search(suffixes, patterns, width)
    met = meet(search.short().drop("letters"), rows.select("id", "seq", "columns").dropDuplicates(["id"]), "id")
    out = met.withColumn("n", F.explode("lengths")).withColumn("pattern", F.substring("seq", F.col("offset"), F.col("n").cast("int")))
    return out.select("pattern", "id", *_ends()).unionByName(search.long(patterns, rows.select("id", "seq", "columns")).select("pattern", "id", *_ends()))


def locate_first(suffixes: DataFrame, patterns: DataFrame, seqs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(pattern, id, offset) of each distinct pattern's first place: the smallest id, then the smallest offset."""
    search = Search(suffixes, patterns, width)

    def make(block):
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.table(block.batch.select([1, 2]).columns, names=["id", "offset"])
        some = block.per_pattern(block.real) > 0
        if not some.any():
            return
        at = np.asarray(pc.sort_indices(rows, [("id", "ascending"), ("offset", "ascending")], null_placement="at_start"))
        rank = np.empty(len(at) + 1, np.int64)
        rank[at] = np.arange(len(at))
        # patterns come last; one more row ends the last stretch
        rank[:-1][~block.real] = rank[-1] = len(at)
        least = np.minimum.reduceat(rank, np.stack([block.begin[some], block.end[some]], 1).ravel())[::2]
        found = block.batch.select([1, 2]).take(pa.array(at[least]))
        yield pa.RecordBatch.from_arrays([_patterns_of(block.what[some]), *found.columns], names=["pattern", "id", "offset"])

    short = search.over(SHORT, make, f"pattern string, id {search.id_type.simpleString()}, offset int")
    return first(short.unionByName(search.long(patterns, seqs.select("id", "seq")).select("pattern", "id", "offset")))


def count_rows(seqs: DataFrame, patterns: DataFrame, width: int = WIDTH) -> DataFrame:
    """(pattern, n_rows): in how many sequences (id, seq; each id once) each distinct pattern stands.  A place counts for the patterns that are longer than what an earlier place of its sequence shares with it."""
    search = Search(places_seen(seqs.dropDuplicates(["id"]), width), patterns, width)

    def make(block):
        seen, n = block.batch.column(3).fill_null(0).to_numpy(), np.zeros(len(block.what), np.int64)
        for k in np.unique(block.size):
            n = np.where(block.size == k, block.per_pattern(block.real & (seen < k)), n)
        yield from _numbers(block, n)

    short = search.over(SHORT, make, "pattern string, n long").groupBy("pattern").agg(F.sum("n").alias("n_rows"))
    return short.unionByName(rows_with(search.long(patterns, seqs.select("id", "seq"))))


def _ends() -> tuple[Column, Column]:
    at = lambda i: F.get("columns", i - 1)
    return at(F.col("offset")).alias("start"), at(F.col("offset") + F.length("pattern") - 1).alias("end")


def columns_of(places: DataFrame, rows: DataFrame) -> DataFrame:
    """(pattern, id, start, end): the columns of places, by the rows (id, columns) that they are in."""
    return places.join(rows.select("id", "columns"), "id").select("pattern", "id", *_ends())


def first(places: DataFrame) -> DataFrame:
    """(pattern, id, offset) of each pattern: the smallest id, then the smallest offset."""
    return places.groupBy("pattern").agg(F.min(F.struct("id", "offset")).alias("x")).select("pattern", "x.id", "x.offset")


def rows_with(places: DataFrame) -> DataFrame:
    """(pattern, n_rows): in how many sequences each pattern stands."""
    return places.groupBy("pattern").agg(F.count_distinct("id").alias("n_rows"))
