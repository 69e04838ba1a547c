"""Operator 10: byte-pair encoding with a given vocabulary, and decoding.

A text is cut at the vocabulary's special strings, normalised (NFC, white space runs to one blank, lower case) and
cut into words.  A word's symbols stand in a doubly linked list; a heap holds the adjacent pairs that have a merge
rank, and entries whose symbols have changed since are skipped when they come up.  Each distinct word is merged once
as long as it stays in a worker's bounded cache; evicting costs time only.

Rows: a null text is an empty text, which has no ids and decodes to ''.  A null doc_id is kept.  Repeated rows are each encoded.  Columns
other than the key and the text column are ignored, whatever their names.  Texts are never cut: memory follows the longest one.
"""

from __future__ import annotations

import heapq
import itertools
import json
import unicodedata

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm.shared import read_table

#: Characters of cached words; a text's own words come on top.
CACHE_CHARS = 4 << 20
ROWS_OUT = 256
#: The characters that the vocabulary's patterns call white space.
SPACE = "\t-\r \x85\xa0" + "".join(map(chr, (0x1680, 0x2000, 0x2D, 0x200A, 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def load_vocabulary(path: str) -> dict:
    """What encoding needs from a tokenizers JSON file with byte-level words and a word-end suffix."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    vocab, suffix = raw["model"]["vocab"], raw["model"]["end_of_word_suffix"] or ""
    merges = [m if isinstance(m, list) else m.split(" ") for m in raw["model"]["merges"]]
    strings = {i: s for s, i in vocab.items()} | {t["id"]: t["content"] for t in raw["added_tokens"]}
    pattern = next(p["pattern"]["Regex"] for p in raw["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    return {
        "vocab": vocab,
        "suffix": suffix,
        "ranks": {vocab[a] << 32 | vocab[b]: rank for rank, (a, b) in enumerate(merges)},
        "merges": [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges],
        "strings": [strings.get(i, "") for i in range(max(strings) + 1)],
        "specials": {t["content"]: t["id"] for t in raw["added_tokens"]},
        "pattern": pattern.replace("\\s", SPACE),
    }


def byte_letters() -> list[str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next free one from U+0100."""
    # fixed values: the visible characters of Latin-1
    seen = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    rest = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(seen))}
    return [chr(rest.get(b, b)) for b in range(256)]


def merge_word(symbols: list[int], ranks: dict[int, int], merges: list[tuple[int, int, int]]) -> list[int]:
    """Merge a word's symbols: lowest rank first, leftmost among equals.  merges[rank]: left, right and joined symbol.

    A heap entry is rank << 32 | place; it is stale if the symbols at its place are no longer the rank's."""
    n = len(symbols)
    get = ranks.get
    heap = [r << 32 | i for i in range(n - 1) if (r := get(symbols[i] << 32 | symbols[i + 1])) is not None]
    if not heap:
        return symbols
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    right, left = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols = [*symbols, -1]  # -1 stands behind the end and in places that were joined
    while heap:
        entry = pop(heap)
        i = entry & 0xFFFFFFFF
        a, b, joined = merges[entry >> 32]
        j = right[i]
        if symbols[i] != a or symbols[j] != b:
            continue
        symbols[i], symbols[j] = joined, -1
        right[i] = k = right[j]
        if k < n:
            left[k] = i
            if (r := get(joined << 32 | symbols[k])) is not None:
                push(heap, r << 32 | i)
        h = left[i]
        if h >= 0 and (r := get(symbols[h] << 32 | joined)) is not None:
            push(heap, r << 32 | h)
    return [s for s in symbols if s >= 0]


class Encoder:
    def __init__(self, v: dict):
        import re

        import regex

        self.v, self.cache, self.held = v, {}, 0
        # the symbols of single bytes, inside a word and at its end
        self.inner = [v["vocab"][c] for c in byte_letters()]
        self.last = [v["vocab"][c + v["suffix"]] for c in byte_letters()]
        self.words = regex.compile(v["pattern"]).findall
        self.blanks = re.compile(f"[{SPACE}]+")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(v["specials"], key=len, reverse=True))) + ")") if v["specials"] else None

    def _word(self, word: str) -> tuple[int, ...]:
        raw, inner = word.encode("utf-8"), self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        return tuple(merge_word(symbols, self.v["ranks"], self.v["merges"]))

    def _plain(self, text: str) -> list[int]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        text = self.blanks.sub(" ", text)
        # one character at a time, so that a final sigma is not special
        text = text.lower() if "Σ" not in text else "".join(c.lower() for c in text)
        words, cache = self.words(text), self.cache
        if self.held > CACHE_CHARS:
            cache.clear()
            self.held = 0
        for w in set(words).difference(cache):
            cache[w] = self._word(w)
            self.held += len(w)
        return list(itertools.chain.from_iterable(map(cache.__getitem__, words)))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        ids: list[int] = []
        for piece in self.cut.split(text):
            if piece in self.v["specials"]:
                ids.append(self.v["specials"][piece])
            elif piece:
                ids += self._plain(piece)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings with a blank between; the file names no decoder that would undo word ends."""
        return " ".join(map(self.v["strings"].__getitem__, ids))


def bpe_round_trip(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids array<int>, decoded string) for each row of df; vocabulary: path of a tokenizers JSON file.

    The file's content (some 50,000 entries) is read on the driver and broadcast, so executors need not have the file."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(vocabulary or default_vocabulary()))
    key_type = df.schema[key].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        encoder = Encoder(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS_OUT):
                part = batch.slice(at, ROWS_OUT)
                ids = [encoder.encode(t.as_py()) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(encoder.decode, ids), pa.string())], names=[key, "ids", "decoded"]
                )

    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {key_type}, ids array<int>, decoded string")


def with_digests(out: DataFrame, key: str = "doc_id") -> DataFrame:
    return out.select(
        key,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_digests(bpe_round_trip(read_table(spark, sf_dir, "documents")))
