"""Operator 3: language-model scores from an n-gram trie in Elias-Fano levels.

Model: trigrams with Dirichlet smoothing over words and one end per text, p(w | u v) = (c(u v w) + MU3 p(w | v)) / (c(u v) + MU3) and p(w | v) = (c(v w) + MU2 p(w)) /
(c(v) + MU2); p(w) is the word's share of the training tokens; an unknown word counts as seen once.  Texts begin with two marks.

The trie is cut into shards by v, the word before the last.  A shard's levels are Elias-Fano sequences, in one flat run of words that can be mapped from a file
(Trie.save, Trie.open) and is mapped anonymously in a task: its words and their counts; its contexts v, their totals and pointers to the words that follow; the
contexts u v below each v, their totals and pointers; and the words that follow u v, each as its number among the words that follow v.  They
are searched as they are coded: a successor is looked for in its context's range only, by selects on the unary parts and a binary search among low
bits.  Probabilities of seen bigrams and trigrams are two bytes each, in steps of 1/64 of a log10, which reach down to 1e-1024; weights of unseen ones
follow from the totals, which are exact.  So a token's log10 probability is off by half a step at most.

Data flow: a first pass counts words and ends.  A second one sends, for units of about UNIT tokens, each distinct trigram once to its shard, with its number in
training texts.  The shard asks for the counts of its words, which meet the table of counted words in buckets of words.  A context v with more than half of a
shard's share of tokens is spread over all shards by u; its total is known from the first pass, and the counts of its bigrams are asked for in the same
way as those of words.  The shard builds its trie, asks it for every distinct trigram, and sends the answers back to the units, where they are summed
by text; so what is moved follows the trigrams.  Frequent words (FREQUENT of them) are moved as two bytes, others as six, which changes sizes and no result.

Rows: a null text is empty and scored as its end alone.  Keys are cast to long; a null key is kept and crc32 of a null counts as training (remainder none).  Repeated rows
are each scored, and each counts in training.  Other columns are ignored.  Whole texts are used; nothing is left out of the counts.
"""

from __future__ import annotations

import mmap

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm import textops as X
from reedbank.llm.elias_fano import Monotone, Successors
from reedbank.llm.shared import parts_for, read_table, small_batches, written

MU2, MU3, UNIT, STEP = 500.0, 10.0, 3 << 18, 1 / 64
#: What answers are rounded to on their way back.
ANSWER_STEP = 1 / 1024
#: Bytes of input for each shard.
SHARD_INPUT = 3 << 20
_BITS = np.uint64((1 << 48) - 1)
BEGIN, FINISH = 1, 2  # reserved word numbers
FREQUENT, RARE = (1 << 16) - 3, np.uint64(1 << 16)


def runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


# ---- the trie


def quantise(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 / STEP), 0, 65535).astype(np.uint16)


class Trie:
    """Levels in one run of uint64 words, searched as they are coded."""

    SEQUENCES = ("words", "word_sums", "contexts", "context_sums", "pair_starts", "pairs", "inner_starts", "inner", "inner_sums", "triple_starts", "triples")
    SCORES = ("pair_scores", "triple_scores")

    def __init__(self, flat: np.ndarray, tokens: int, mu2: float = MU2, mu3: float = MU3):
        self.flat, self.tokens, self.mu2, self.mu3 = flat, tokens, mu2, mu3
        level, at = {}, 0
        for name in self.SEQUENCES:
            level[name] = Monotone(flat[at:])
            at += level[name].size
        for name, of in zip(self.SCORES, ("pairs", "triples"), strict=True):
            n = level[of].n
            level[name] = flat[at:].view(np.uint16)[:n]
            at += (n + 3) // 4
        self.level = level
        self.pairs = Successors(level["pair_starts"], level["pairs"])
        self.inner = Successors(level["inner_starts"], level["inner"])
        self.triples = Successors(level["triple_starts"], level["triples"])

    @classmethod
    def build(cls, words, word_times, contexts, totals, pairs, triples, tokens: int, mu2: float = MU2, mu3: float = MU3) -> Trie:
        """words: sorted ids, and their counts.  contexts: sorted word numbers v, and c(v).  pairs: (place of v in contexts, w, count), sorted and distinct.  triples:
        (place of v in contexts, u, w, count), sorted and distinct, where v w is one of the pairs."""
        pc, pw, pn = pairs
        tc, tu, tw, tn = triples
        share = np.maximum(word_times, 1) / (tokens + 1)
        n_words = max(1, len(words))
        p2 = (pn + mu2 * share[pw]) / (totals[pc] + mu2)
        pair_starts = np.searchsorted(pc, np.arange(len(contexts) + 1))
        pair_of = np.searchsorted(pc * n_words + pw, tc * n_words + tw)
        inner = runs(tc * n_words + tu)
        sizes = np.diff(np.r_[inner, len(tc)])
        inner_totals = np.add.reduceat(tn, inner) if len(inner) else np.zeros(0, np.int64)
        p3 = (tn + mu3 * p2[pair_of]) / (np.repeat(inner_totals, sizes) + mu3)
        sums = lambda x: Monotone.encode(np.r_[0, np.cumsum(x)])
        made = [Monotone.encode(words), sums(word_times), Monotone.encode(contexts), sums(totals)]
        made += Successors.encode(pair_starts, pw)
        made += [*Successors.encode(np.searchsorted(tc[inner], np.arange(len(contexts) + 1)), tu[inner]), sums(inner_totals)]
        made += Successors.encode(np.r_[inner, len(tc)], pair_of - pair_starts[tc])
        for p in (p2, p3):
            codes = np.zeros(-(-len(p) // 4) * 4, np.uint16)
            codes[: len(p)] = quantise(np.log10(p))
            made.append(codes.view(np.uint64))
        size = sum(len(x) for x in made)
        flat = np.frombuffer(mmap.mmap(-1, max(1, size) * 8), np.uint64)
        at = 0
        for x in made:
            flat[at : at + len(x)] = x
            at += len(x)
        return cls(flat, tokens, mu2, mu3)

    def save(self, path: str) -> None:
        self.flat.tofile(path)

    @classmethod
    def open(cls, path: str, tokens: int, mu2: float = MU2, mu3: float = MU3) -> Trie:
        return cls(np.memmap(path, np.uint64, "r"), tokens, mu2, mu3)

    def _whole(self, name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        level = self.level[name]
        return level.find(x, np.zeros(len(x), np.int64), np.full(len(x), level.n))

    def _between(self, name: str, at: np.ndarray) -> np.ndarray:
        return self.level[name].get(at + 1) - self.level[name].get(at)

    def numbers(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number or -1, log10 p, c as a context) of words."""
        at, hit = self._whole("words", ids)
        number = np.where(hit, at, -1)
        times = np.zeros(len(ids), np.int64)
        times[hit] = self._between("word_sums", at[hit])
        place, known = self._whole("contexts", number)
        known &= hit
        total = np.zeros(len(ids), np.int64)
        total[known] = self._between("context_sums", place[known])
        return number, np.log10(np.maximum(times, 1) / (self.tokens + 1)), total

    def log10(self, u: np.ndarray, v: np.ndarray, w: np.ndarray, log_word: np.ndarray) -> np.ndarray:
        """log10 p(w | u v) of word numbers (-1: not in the trie), in the order of (v, u); log_word: log10 p(w)."""
        n = len(v)
        head = np.flatnonzero(np.r_[True, (v[1:] != v[:-1])]) if n else np.zeros(0, np.int64)
        of = np.repeat(np.arange(len(head)), np.diff(np.r_[head, n]))
        place, known = self._whole("contexts", v[head])
        known &= v[head] >= 0
        place[~known] = 0
        some = np.flatnonzero(known)

        def at_known(values, size, where):
            out = np.zeros(size, values.dtype)
            out[where] = values
            return out

        # bigrams
        ranges = [at_known(x, len(head), some)[of] for x in self.pairs.ranges(place[some])]
        rank, hit2 = self.pairs.find(ranges, w)
        hit2 &= w >= 0
        total = at_known(self._between("context_sums", place[some]), len(head), some)
        out = np.log10(self.mu2 / (total + self.mu2))[of] + log_word
        out[hit2] = -STEP * self.level["pair_scores"][rank[hit2]]
        rank = rank - ranges[0]
        # contexts u v
        new = np.flatnonzero(np.r_[True, (v[1:] != v[:-1]) | (u[1:] != u[:-1])]) if n else head
        of3 = np.repeat(np.arange(len(new)), np.diff(np.r_[new, n]))
        ranges = [at_known(x, len(head), some)[of[new]] for x in self.inner.ranges(place[some])]
        inner, known3 = self.inner.find(ranges, u[new])
        known3 &= u[new] >= 0
        some3 = np.flatnonzero(known3)
        total3 = at_known(self._between("inner_sums", inner[some3]), len(new), some3)
        ranges = [at_known(x, len(new), some3)[of3] for x in self.triples.ranges(inner[some3])]
        # trigrams, by the word's number among those that follow v
        at, hit3 = self.triples.find(ranges, rank)
        hit3 &= hit2
        out += np.log10(self.mu3 / (total3 + self.mu3))[of3]
        out[hit3] = -STEP * self.level["triple_scores"][at[hit3]]
        return out


# ---- what is moved


def packed(values: np.ndarray) -> bytes:
    """Bytes for the shuffle: planes of bytes, entropy-coded, which suits small numbers better than the shuffle's own codec."""
    import zstandard

    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpacked(data, kind) -> np.ndarray:
    import zstandard

    size = np.dtype(kind).itemsize
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def six_bytes(words: np.ndarray) -> np.ndarray:
    return words.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]


def from_six(data) -> np.ndarray:
    six = np.frombuffer(data, np.uint8).reshape(-1, 6)
    wide = np.zeros((len(six), 8), np.uint8)
    wide[:, :6] = six
    return wide.view("<u8").ravel()


def ids_out(ids: np.ndarray) -> tuple[bytes, bytes]:
    """Ids as two bytes each, 0 for rare words, and the rare ones."""
    rare = ids >= RARE
    return packed(np.where(rare, 0, ids).astype(np.uint16)), six_bytes(ids[rare]).tobytes()


def ids_in(codes, rare) -> np.ndarray:
    out = unpacked(codes, np.uint16).astype(np.uint64)
    out[out == 0] = from_six(rare)
    return out


# ---- tokens


def block_tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of a block's words and the bounds of its rows."""
    words = X.Words(data, offsets, X.NON_SPACE)
    tokens = words.hash & _BITS
    return np.where(tokens < RARE, tokens + RARE, tokens), words.first


class Unigrams:
    """What every worker knows, bounded in size: the sums over all words, the FREQUENT most frequent words, and the words that may be spread contexts
    (two a shard at most)."""

    def __init__(self, frequent: np.ndarray, heavy: list[tuple[int, int]], tokens: int, distinct: int, texts: int, shards: int):
        self.tokens, self.distinct, self.texts = tokens, distinct, texts
        self.order = np.argsort(frequent)
        self.frequent = frequent[self.order]
        spread = sorted((int(self.ids(np.array([w], np.uint64))[0]), c) for w, c in heavy)
        spread = ([(BEGIN, texts)] if texts * 2 * shards >= tokens else []) + spread
        self.spread = np.array([s[0] for s in spread], np.uint64)
        self.spread_total = np.array([s[1] for s in spread], np.int64)

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes: 3 and on for frequent words, the hash for others."""
        if not len(self.frequent):
            return hashes
        at = np.minimum(np.searchsorted(self.frequent, hashes), len(self.frequent) - 1)
        return np.where(self.frequent[at] == hashes, self.order[at].astype(np.uint64) + np.uint64(3), hashes)

    def is_spread(self, ids: np.ndarray) -> np.ndarray:
        return np.isin(ids, self.spread)


def bigram_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return X.mix64(X.mix64(v) * X._GOLD + w) & _BITS


def count_words(training: DataFrame) -> DataFrame:
    """(word, times) over the texts of training."""

    def run(batches):
        import pyarrow as pa

        waiting, held = [], 0

        def counted():
            word, times = np.unique(np.concatenate(waiting), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(times, pa.int64())], names=["word", "times"])

        for batch in batches:
            data, offsets = X.column_bytes(batch.column(0))
            for _, _, block, own in X.blocks(data, offsets):
                tokens, first = block_tokens(block, own)
                waiting += [tokens, np.full(len(first) - 1, FINISH, np.uint64)]
                held += len(tokens)
                if held >= 2 * UNIT:
                    yield counted()
                    waiting, held = [], 0
        if waiting:
            yield counted()

    return training.select("text").mapInArrow(run, "word bigint, times bigint").groupBy("word").agg(F.sum("times").alias("times"))


UNITS = "shard int, own bigint, unit bigint, n_contexts int, n_inner int, codes binary, rare binary, sizes binary, keys binary"


def _units(source: DataFrame, unigrams, shards: int, buckets: int) -> DataFrame:
    """A unit's rows: for each shard its trigrams in the order of (v, u, w) (own is -1); for each bucket of bigrams of spread contexts their counts (shard is -2 and
    less); and one of shard -1 with the unit's texts and where each trigram stands in them (own is the unit)."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        known, part = unigrams.value, TaskContext.get().partitionId()
        waiting: list = []
        made = 0

        def unit():
            tokens, sizes = np.concatenate([x[0] for x in waiting]), np.concatenate([x[1] for x in waiting])
            train = np.concatenate([x[3] for x in waiting])
            # numbers of the unit's words, in the order of ids
            hashes, own = np.unique(tokens, return_inverse=True)
            ids = known.ids(hashes)
            order = np.argsort(ids)
            ids = np.r_[np.array([BEGIN, FINISH], np.uint64), ids[order]]
            number = np.empty(len(hashes), np.int64)
            number[order] = np.arange(2, len(ids))
            n_words, n, texts = len(ids), len(tokens) + len(sizes), len(sizes)
            ends = np.cumsum(sizes + 1) - 1
            w = np.ones(n, np.int64)
            inside = np.ones(n, bool)
            inside[ends] = False
            w[inside] = number[own]
            starts = ends - sizes
            v, u = np.zeros(n, np.int64), np.zeros(n, np.int64)
            v[1:] = w[:-1]
            v[starts] = 0
            u[1:] = v[:-1]
            u[starts] = 0
            row = np.repeat(np.arange(texts), sizes + 1)
            # distinct contexts in the order of (shard, v, u), then trigrams
            contexts, context_of = np.unique(v * n_words + u, return_inverse=True)
            cv, cu = contexts // n_words, contexts % n_words
            with np.errstate(over="ignore"):
                deal = np.where(known.is_spread(ids)[cv], ids[cv] * X._GOLD + ids[cu], ids[cv])
            shard = (X.mix64(deal) % np.uint64(shards)).astype(np.int32 if shards > 1 << 15 else np.int16)
            order = np.argsort(shard, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            cv, cu, shard = cv[order], cu[order], shard[order]
            place = rank[context_of] * n_words + w
            order = np.argsort(place, kind="stable")
            place, row = place[order], row[order]
            pair = runs(place)
            times = np.diff(np.r_[pair, n]).astype(np.uint32)
            trained = np.add.reduceat(train[row].astype(np.uint32), pair, dtype=np.uint32)
            pair_context, pair_word = place[pair] // n_words, place[pair] % n_words
            per_context = np.bincount(pair_context, minlength=len(cv)).astype(np.uint32)
            head = np.flatnonzero(np.r_[True, (cv[1:] != cv[:-1]) | (shard[1:] != shard[:-1])])
            per_head = np.diff(np.r_[head, len(cv)]).astype(np.uint32)
            cut_c = np.searchsorted(shard, np.arange(shards + 1))
            cut_h, cut_p = np.searchsorted(head, cut_c), np.searchsorted(pair_context, cut_c)
            # the unit's number must be the same if the task runs again
            unit_number = (part << 24) | made
            rows = []
            for s in np.flatnonzero(np.diff(cut_c)):
                h, c, p = (slice(x[s], x[s + 1]) for x in (cut_h, cut_c, cut_p))
                codes, rare = ids_out(ids[np.concatenate([cv[head[h]], cu[c], pair_word[p]])])
                rows.append((int(s), -1, unit_number, h.stop - h.start, c.stop - c.start, codes, rare, packed(np.concatenate([per_head[h], per_context[c], trained[p]])), b""))
            # bigrams of spread contexts
            wide = np.flatnonzero(known.is_spread(ids)[cv[pair_context]] & (trained > 0))
            if len(wide):
                which, back = np.unique(cv[pair_context[wide]] * n_words + pair_word[wide], return_inverse=True)
                counts = np.bincount(back, weights=trained[wide]).astype(np.uint32)
                key = bigram_key(ids[which // n_words], ids[which % n_words])
                bucket = (X.mix64(key) % np.uint64(buckets)).astype(np.int64)
                order = np.lexsort((key, bucket))
                key, counts = key[order], counts[order]
                cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
                for b in np.flatnonzero(np.diff(cut)):
                    x = slice(cut[b], cut[b + 1])
                    rows.append((int(-2 - b), -1, unit_number, 0, 0, b"", six_bytes(key[x]).tobytes(), packed(counts[x]), b""))
            sink = pa.BufferOutputStream()
            keys = pa.record_batch([pa.concat_arrays([x[2] for x in waiting]), pa.array(~train), pa.array(sizes + 1)], names=["key", "held", "n"])
            with pa.ipc.new_stream(sink, keys.schema) as f:
                f.write_batch(keys)
            owners = row.astype(np.uint16 if texts <= 1 << 16 else np.uint32)
            pairs_of_head = np.add.reduceat(per_context, head, dtype=np.uint32)
            rows.append((-1, unit_number, unit_number, 0, 0, packed(times), packed(owners), packed(pairs_of_head), sink.getvalue().to_pybytes()))
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()] + [pa.binary()] * 4
            names = ["shard", "own", "unit", "n_contexts", "n_inner", "codes", "rare", "sizes", "keys"]
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        held = 0
        for batch in batches:
            data, offsets = X.column_bytes(batch.column(2))
            flags = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            for row, end, block, own in X.blocks(data, offsets):
                tokens, first = block_tokens(block, own)
                waiting.append((tokens, np.diff(first), batch.column(0).slice(row, end - row), flags[row:end]))
                held += len(tokens) + end - row
                if held >= UNIT:
                    yield unit()
                    waiting, held, made = [], 0, made + 1
        if waiting:
            yield unit()

    return source.mapInArrow(run, UNITS)


class ShardRows:
    """All units' trigrams of a shard, as numbers of its words."""

    def __init__(self, table):
        blob = lambda k, i: table.column(k)[i].as_buffer()
        n = table.num_rows
        ids, back = np.unique(np.concatenate([ids_in(blob("codes", i), blob("rare", i)) for i in range(n)]), return_inverse=True)
        self.ids, self.n_words = ids, len(ids)
        at, self.heads, context, word, trained, self.pairs = 0, [], [], [], [], []
        for i in range(n):
            h, c = table.column("n_contexts")[i].as_py(), table.column("n_inner")[i].as_py()
            sizes = unpacked(blob("sizes", i), np.uint32)
            p = len(sizes) - h - c
            v, u, w = np.split(back[at : at + len(sizes)], [h, h + c])
            at += len(sizes)
            context.append(np.repeat(np.repeat(v, sizes[:h]) * self.n_words + u, sizes[h : h + c]))
            word.append(w)
            trained.append(sizes[h + c :])
            self.heads.append(v)
            self.pairs.append(p)
        # distinct trigrams in the order of (v, u, w), and which one each of the rows' is
        contexts, of = np.unique(np.concatenate(context), return_inverse=True)
        key, self.back = np.unique(of * self.n_words + np.concatenate(word), return_inverse=True)
        self.times = np.bincount(self.back, weights=np.concatenate(trained), minlength=len(key)).astype(np.int64)
        context = contexts[key // self.n_words]
        self.v, self.u, self.w = context // self.n_words, context % self.n_words, key % self.n_words

    def wanted(self, unigrams: Unigrams) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(numbers of the words that are asked for, bigrams that are asked for as v and w)."""
        is_next = np.zeros(self.n_words, bool)
        is_next[self.w] = True
        wide = np.flatnonzero(unigrams.is_spread(self.ids)[self.v])
        bigrams = np.unique(self.v[wide] * self.n_words + self.w[wide])
        return np.flatnonzero(is_next), bigrams // self.n_words, bigrams % self.n_words


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys by bucket, and the bounds of the buckets in it."""
    bucket = (X.mix64(keys) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


REQUEST = "bucket int, shard int, own bigint, words binary, times binary"


def _request_table(rows: list[tuple]):
    import pyarrow as pa

    kinds = {"bucket": pa.int32(), "shard": pa.int32(), "own": pa.int64(), "words": pa.binary(), "times": pa.binary()}
    return pa.table({k: pa.array([r[i] for r in rows], t) for i, (k, t) in enumerate(kinds.items())})


def _requests(units: DataFrame, unigrams, buckets: int) -> DataFrame:
    """What a shard asks for: a row for each bucket of words, and for each one of bigrams (buckets and on); and the counts of bigrams, as rows of shard -1."""

    def run(key, table):
        s = key[0].as_py()
        if s == -1:
            return _request_table([])
        if s < -1:
            return _request_table([(buckets - 2 - s, -1, -1, table.column("rare")[i].as_py(), packed(unpacked(table.column("sizes")[i].as_buffer(), np.uint32).astype(np.int64))) for i in range(table.num_rows)])
        rows = ShardRows(table)
        words, v, w = rows.wanted(unigrams.value)
        out = []
        for base, keys in ((0, rows.ids[words]), (buckets, bigram_key(rows.ids[v], rows.ids[w]))):
            order, cut = in_buckets(keys, buckets)
            keys = keys[order]
            out += [(int(base + b), s, -1, six_bytes(keys[cut[b] : cut[b + 1]]).tobytes(), b"") for b in np.flatnonzero(np.diff(cut))]
        return _request_table(out)

    return units.groupBy("shard", "own").applyInArrow(run, REQUEST)


def _counted(words: DataFrame, unigrams, buckets: int) -> DataFrame:
    """The table of counted words, as rows of shard -1 for the buckets."""

    def run(batches):
        waiting, held = [], 0

        def dealt():
            word, times = (np.concatenate([x[i] for x in waiting]) for i in range(2))
            word = unigrams.value.ids(word)
            order, cut = in_buckets(word, buckets)
            word, times = word[order], times[order]
            rows = [(int(b), -1, -1, six_bytes(word[cut[b] : cut[b + 1]]).tobytes(), packed(times[cut[b] : cut[b + 1]])) for b in np.flatnonzero(np.diff(cut))]
            return _request_table(rows).to_batches()

        for batch in batches:
            waiting.append((batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()))
            held += batch.num_rows
            if held >= UNIT:
                yield from dealt()
                waiting, held = [], 0
        if waiting:
            yield from dealt()

    return words.select("word", "times").mapInArrow(run, REQUEST)


def _replies(requests: DataFrame) -> DataFrame:
    """For each request the counts of its words or bigrams, 0 for those that training texts do not have."""

    def run(table):
        import pyarrow as pa

        shard = table.column("shard").to_numpy()
        blob = lambda k, i: table.column(k)[i].as_buffer()
        known = np.flatnonzero(shard < 0)
        word = np.concatenate([np.zeros(0, np.uint64), *[from_six(blob("words", i)) for i in known]])
        times = np.concatenate([np.zeros(0, np.int64), *[unpacked(blob("times", i), np.int64) for i in known]])
        word, back = np.unique(word, return_inverse=True)
        times = np.bincount(back, weights=times, minlength=len(word)).astype(np.int64)
        asked = np.flatnonzero(shard >= 0)
        out = []
        for i in asked:
            ask = from_six(blob("words", i))
            got = np.zeros(len(ask), np.int64)
            if len(word):
                at = np.minimum(np.searchsorted(word, ask), len(word) - 1)
                got = np.where(word[at] == ask, times[at], 0)
            out.append(packed(got))
        return pa.table({k: table.column(k).take(asked) for k in ("shard", "own", "bucket")} | {"times": pa.array(out, pa.binary())})

    return requests.groupBy("bucket").applyInArrow(run, "shard int, own bigint, bucket int, times binary")


ANSWER = "shard int, unit bigint, totals binary, scores binary, sizes binary, times binary, owners binary, keys binary"


def _answers(units: DataFrame, replies: DataFrame, unigrams, shards: int, buckets: int) -> DataFrame:
    """A shard's answers to each unit: totals of its contexts (-1 for the beginning of texts) and log10 p of its trigrams; rows of shard -1 pass."""

    def run(key, table, counts):
        import pyarrow as pa

        known = unigrams.value
        n = table.num_rows
        empty = pa.array([b""] * n, pa.binary())
        col = table.column
        if key[0].as_py() == -1:
            return pa.table({"shard": col("shard"), "unit": col("unit"), "totals": empty, "scores": empty, "sizes": col("sizes"), "times": col("codes"), "owners": col("rare"), "keys": col("keys")})
        if key[0].as_py() < -1:
            return pa.Table.from_batches([], pa.schema([("shard", pa.int32()), ("unit", pa.int64()), *[(k, pa.binary()) for k in ("totals", "scores", "sizes", "times", "owners", "keys")]]))
        rows = ShardRows(table)
        words, bv, bw = rows.wanted(known)
        # counts of words and of spread contexts' bigrams, in the order of asking
        got = [np.zeros(len(words), np.int64), np.zeros(len(bv), np.int64)]
        slots = [in_buckets(rows.ids[words], buckets), in_buckets(bigram_key(rows.ids[bv], rows.ids[bw]), buckets)]
        for bucket, blob in zip(counts.column("bucket").to_pylist(), counts.column("times"), strict=True):
            (order, cut), b = slots[bucket // buckets], bucket % buckets
            got[bucket // buckets][order[cut[b] : cut[b + 1]]] = unpacked(blob.as_buffer(), np.int64)
        word_times = np.zeros(rows.n_words, np.int64)
        word_times[words] = got[0]
        word_times[rows.ids == FINISH] = known.texts
        # trained trigrams; totals of contexts: all of a context's are here, or the context is spread and known
        seen = np.flatnonzero(rows.times)
        v, u, w, times = rows.v[seen], rows.u[seen], rows.w[seen], rows.times[seen]
        wide = known.is_spread(rows.ids)
        total = np.bincount(v, weights=times, minlength=rows.n_words).astype(np.int64)
        at = np.flatnonzero(wide)
        total[at] = known.spread_total[np.searchsorted(known.spread, rows.ids[at])]
        # bigrams: from the trigrams, or asked for
        thin = np.flatnonzero(~wide[v])
        pair, back = np.unique(v[thin] * rows.n_words + w[thin], return_inverse=True)
        pair_times = np.bincount(back, weights=times[thin], minlength=len(pair)).astype(np.int64)
        some = got[1] > 0
        pair, pair_times = np.r_[pair, (bv * rows.n_words + bw)[some]], np.r_[pair_times, got[1][some]]
        order = np.argsort(pair)
        pair, pair_times = pair[order], pair_times[order]
        # the trie has the words that training texts have
        used = (word_times > 0) | (total > 0)
        used[u] = used[v] = used[w] = True
        number = np.cumsum(used) - 1
        contexts = np.flatnonzero(total)
        place = np.searchsorted(contexts, np.arange(rows.n_words))
        trie = Trie.build(
            rows.ids[used], word_times[used], number[contexts], total[contexts], (place[pair // rows.n_words], number[pair % rows.n_words], pair_times), (place[v], number[u], number[w], times), known.tokens
        )
        del v, u, w, times, pair, pair_times, back, seen, thin
        number, log_word, total = trie.numbers(rows.ids)
        scores = np.concatenate([np.zeros(0)] + [trie.log10(number[rows.u[a:z]], number[rows.v[a:z]], number[rows.w[a:z]], log_word[rows.w[a:z]]) for a, z in pieces(len(rows.v))])
        scores = np.rint(-scores / ANSWER_STEP).astype(np.uint32)[rows.back]
        total[rows.ids == BEGIN] = -1
        answers = [packed(total[v]) for v in rows.heads]
        bounds = np.cumsum([0, *rows.pairs])
        return pa.table(
            {
                "shard": col("shard"),
                "unit": col("unit"),
                "totals": pa.array(answers, pa.binary()),
                "scores": pa.array([packed(scores[a:z]) for a, z in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                "sizes": empty,
                "times": empty,
                "owners": empty,
                "keys": empty,
            }
        )

    return units.groupBy("shard", "own").cogroup(replies.groupBy("shard", "own")).applyInArrow(run, ANSWER)


def pieces(n: int, size: int = 1 << 18):
    return [(a, min(n, a + size)) for a in range(0, n, size)]


def _by_row(answers: DataFrame, unigrams) -> DataFrame:
    """A unit's answers, summed up by text."""

    def run(table):
        import pyarrow as pa

        known = unigrams.value
        at = {s: i for i, s in enumerate(table.column("shard").to_pylist())}
        read = lambda k, s, t: unpacked(table.column(k)[at[s]].as_buffer(), t)
        order = sorted(s for s in at if s >= 0)
        totals = np.concatenate([read("totals", s, np.int64) for s in order])
        scores = -ANSWER_STEP * np.concatenate([read("scores", s, np.uint32) for s in order])
        keys = pa.ipc.open_stream(table.column("keys")[at[-1]].as_buffer()).read_all()
        n = keys.num_rows
        times = read("times", -1, np.uint32)
        owners = read("owners", -1, np.uint16 if n <= 1 << 16 else np.uint32)
        base = np.where(totals < 0, 0.0, np.log10((np.maximum(totals, 0) + 1) / (known.tokens + known.distinct + 1)))
        pair_of = np.repeat(np.arange(len(scores)), times)
        context_of = np.repeat(np.arange(len(totals)), read("sizes", -1, np.uint32))[pair_of]
        add = lambda x: np.bincount(owners, weights=x, minlength=n)
        # the end of each text is a token as well
        ends = np.log10((known.texts + 1) / (known.tokens + known.distinct + 1))
        hits = add((totals > 0)[context_of].astype(np.float64)).astype(np.int64) + (known.texts > 0)
        return pa.table(
            {"key": keys.column("key"), "held_out": keys.column("held"), "n_tokens": keys.column("n"), "n_known": pa.array(hits), "base_score": pa.array(add(base[context_of]) + ends), "score": pa.array(add(scores[pair_of]))}
        )

    return answers.groupBy("unit").applyInArrow(run, "key bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def train_and_score(documents: DataFrame, train, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row; train: a boolean column, which rows are learnt from."""
    small_batches(documents.sparkSession)
    source = documents.select(F.col(key).cast("long").alias("key"), F.coalesce(train, F.lit(True)).alias("train"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = written(count_words(source.where("train")), "op3_words")
    sums = words.agg(F.coalesce(F.sum("times"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("word") == FINISH, F.col("times"))), F.lit(0))).first()
    tokens, distinct, texts = map(int, sums)
    shards = parts_for(documents, text, SHARD_INPUT, 12)
    buckets = max(12, shards // 8)
    plain = words.where(F.col("word") != FINISH)
    frequent = np.array([r.word for r in plain.orderBy(F.desc("times"), "word").limit(FREQUENT).select("word").collect()], np.int64).view(np.uint64)
    # 2 * shards of them at most, as their counts add up to no more than all tokens
    heavy = [(r.word, r.times) for r in plain.where(F.col("times") * (2 * shards) >= tokens).collect()]
    unigrams = documents.sparkSession.sparkContext.broadcast(Unigrams(frequent, heavy, tokens, distinct, texts, shards))
    # both readers of units take them from one exchange
    units = _units(source, unigrams, shards, buckets)
    replies = _replies(_requests(units, unigrams, buckets).unionByName(_counted(plain, unigrams, buckets)))
    out = _by_row(_answers(units, replies, unigrams, shards, buckets), unigrams)
    return out.withColumn("train_tokens", F.lit(tokens).cast("long")).withColumnRenamed("key", key)


def op3_lm_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    train = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2
    return train_and_score(documents, train).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
