"""Operator 13: toxicity by a weighted lexicon, matched with an Aho-Corasick automaton after folding.

Folding undoes disguises: compatibility forms and case are made plain, marks and characters without width go, letters that look like Latin ones become those, and digits and
signs inside words become the letters that they stand for (i, l and 1 are one letter).  Numbers by themselves are no words.  The lexicon holds whole folded
words whose share among toxic labelled texts is far above that among the others; a word weighs the logarithm of that ratio.  Exception phrases (given ones, and
learnt ones: pairs with a word that leans to toxic texts, which themselves don't, and in which a good part of that word's clean texts have it) take the hits that lie
inside them away, and their occurrences don't count for a word's weight.  All patterns
are in one automaton.  A text's density is the sum of its hits' weights by the square root of its words; a logistic curve makes it a score.  The curve is
fitted to densities of halves of the sample under the lexicon of the other half, so words that are there by chance don't steepen it.

The sample is bounded: at most SAMPLE labelled keys, the ones with the smallest hashes, each with one text (the one with the smallest hash).  Its words are counted by Spark; what
comes to the driver is at most LEXICON words and EXCEPTIONS phrases for each half and the whole, and a density for each text of the sample.  Rows whose crc32 of the key (as text) is 1
modulo 3 are held out and never learnt from.

Rows: null and empty texts have no hits and get the score of a text without hits.  Null keys are scored and never learnt from.  Repeated label rows count as their
largest label, null labels not at all; without labels of both kinds every score is 0.  Repeated rows score alike.  Other columns are ignored, whatever their names.  Whole texts are used.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from itertools import pairwise

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm.op07_quality_knn import crc_mod
from reedbank.llm.shared import read_table, written

SAMPLE, LEXICON, EXCEPTIONS, THRESHOLD = 32_768, 4096, 256, 0.7
#: Tasks that work on the sample.
SAMPLE_PARTS = 16
#: A lexicon word stands in this many toxic texts at least, and has this weight at least.
LEAST_TEXTS, LEAST_WEIGHT = 3, 2.0
#: Texts labelled clean that a learnt exception phrase stands in at least, and their share of those with its lexicon word.
LEAST_CLEAN, LEAST_SHARE = 10, 0.1

# fixed values: letters of other scripts that look like Latin ones, lower case
LOOKS_LIKE = {
    "a": "аαɑ", "b": "вƅ", "c": "сϲ", "d": "ԁɗ", "e": "еεєҽ", "g": "ɡ", "h": "һн", "i": "іιıɩ", "j": "јϳ", "k": "кκ", "l": "ӏɭł", "m": "мϻ", "n": "ոռ", "o": "оοσօø", "p": "рρ",
    "q": "ԛ", "r": "гɾ", "s": "ѕꜱ", "t": "тτ", "u": "υսʋ", "v": "νѵ", "w": "ԝѡω", "x": "хχ", "y": "уγү", "z": "ʐ",
}
# fixed values: digits and signs that are written for letters
STANDS_FOR = {"0": "o", "1": "i", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s"}
FOLD = str.maketrans({c: latin for latin, many in LOOKS_LIKE.items() for c in many} | STANDS_FOR | {c: "i" for c in ("l", *LOOKS_LIKE["l"])})
#: Marks above and below letters, and characters without width.
HIDDEN = re.compile("[̀-ͯ­​-‏⁠-⁤︀-️﻿]+")
DIGITS, NUMBERS = re.compile("[0-9@$_]"), re.compile(r"(?<![\w@$])[0-9@$_]+(?![\w@$])")
WORDS = re.compile(r"[^\W_]+")
TOKENS = re.compile(r"([^\W_]+)([\W_]*)")


def fold(text: str | None) -> tuple[str, int]:
    """The folded text with single blanks, and its number of words."""
    if not text:
        return "", 0
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
        if HIDDEN.search(text):
            text = HIDDEN.sub("", text)
    text = text.lower()
    if DIGITS.search(text):
        text = NUMBERS.sub(" ", text)
    words = text.split()
    return " ".join(words).translate(FOLD), len(words)


class Matcher:
    """All patterns in one automaton; weights: folded word to weight, exceptions: folded phrases."""

    def __init__(self, weights: dict[str, float], exceptions: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for phrase in exceptions:
            self.automaton.add_word(phrase, (phrase, None))
        for word, weight in weights.items():
            self.automaton.add_word(word, (word, weight))
        self.filled = len(self.automaton) > 0
        if self.filled:
            self.automaton.make_automaton()

    def hits(self, folded: str) -> list[tuple[str, float]]:
        """(word, weight) of each lexicon word that stands in the text as a whole word and in no exception phrase."""
        if not self.filled or not folded:
            return []
        found, spared, last = [], [], len(folded)
        for end, (pattern, weight) in self.automaton.iter(folded):
            start, end = end + 1 - len(pattern), end + 1
            if (start and folded[start - 1].isalnum()) or (end < last and folded[end].isalnum()):
                continue
            if weight is None:
                spared.append((start, end))
            else:
                found.append((start, end, pattern, weight))
        if spared:
            # both by start; of the phrases that begin at or before a hit the one that reaches farthest decides
            found.sort()
            spared.sort()
            left, at, reach = [], 0, 0
            for start, end, pattern, weight in found:
                while at < len(spared) and spared[at][0] <= start:
                    reach, at = max(reach, spared[at][1]), at + 1
                if reach < end:
                    left.append((start, end, pattern, weight))
            found = left
        return [(pattern, weight) for _, _, pattern, weight in found]

    def without(self, folded: str) -> str:
        """The text with the exception phrases blanked."""
        if not self.filled:
            return folded
        out, at = [], 0
        for start, end in sorted((e + 1 - len(p), e + 1) for e, (p, w) in self.automaton.iter(folded) if w is None):
            if (not start or not folded[start - 1].isalnum()) and (end == len(folded) or not folded[end].isalnum()):
                out.append(folded[at:start])
                at = max(at, end)
        return " ".join([*out, folded[at:]])

    def density(self, folded: str, n: int) -> tuple[float, list[tuple[str, float]]]:
        """Of a folded text of n words, and its hits."""
        hits = self.hits(folded)
        return math.fsum(w for _, w in hits) / math.sqrt(1 + n), hits


def curve(labels: np.ndarray, densities: np.ndarray) -> tuple[float, float]:
    """Bias and slope of the logistic curve, with a small penalty on the slope (Newton steps, halved where they don't help)."""
    x = np.stack([np.ones(len(densities)), densities], 1)
    penalty = np.diag([1e-3, 1e-2])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.logaddexp(0, z).sum() - labels @ z + w @ penalty @ w / 2)

    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - labels) + penalty @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def _folded(batches):
    import pyarrow as pa

    for batch in batches:
        rows = [fold(x.as_py()) for x in batch.column(0)]
        arrays = [pa.array([x for x, _ in rows], pa.string()), pa.array([n for _, n in rows], pa.int32()), batch.column(1), batch.column(2)]
        yield pa.RecordBatch.from_arrays(arrays, names=["folded", "words", "label", "half"])


def _counted(sample: DataFrame, terms, tool=lambda: None) -> DataFrame:
    """(term, t0, c0, t1, c1: toxic and clean texts with it, by half) over the sample; terms: what to count in a folded text, given what tool makes once a task.  Counts are
    added up in a task first."""

    def run(batches):
        import pyarrow as pa

        counts, made = [Counter() for _ in range(4)], tool()
        for batch in batches:
            for text, label, half in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                counts[2 * half.as_py() + (label.as_py() == 0)].update(set(terms(text.as_py(), made)))
            if sum(map(len, counts)) > 1 << 20:
                yield from rows(pa, counts)
                counts = [Counter() for _ in range(4)]
        yield from rows(pa, counts)

    def rows(pa, counts):
        words = sorted(set().union(*counts))
        for at in range(0, len(words), 65_536):
            part = words[at : at + 65_536]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), *[pa.array([c[w] for w in part], pa.int64()) for c in counts]], names=["term", "t0", "c0", "t1", "c1"])

    parts = sample.select("folded", "label", "half").mapInArrow(run, "term string, t0 long, c0 long, t1 long, c1 long")
    return parts.groupBy("term").agg(*[F.sum(c).alias(c) for c in ("t0", "c0", "t1", "c1")])


def _weight(toxic: Column, clean: Column, n_toxic: int, n_clean: int) -> Column:
    """Logarithm of the ratio of a word's smoothed shares among toxic and clean texts."""
    return F.least(F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1)), F.lit(10.0))


def _lexicon(words: DataFrame, toxic: Column, clean: Column, n_toxic: int, n_clean: int, size: int) -> dict[str, float]:
    """Weights of at most size words, of those with the most evidence."""
    best = words.select("term", toxic.alias("n"), _weight(toxic, clean, n_toxic, n_clean).alias("weight")).where((F.col("n") >= LEAST_TEXTS) & (F.col("weight") >= LEAST_WEIGHT))
    return {r.term: r.weight for r in best.orderBy((F.col("n") * F.col("weight")).desc(), "term").limit(size).collect()}


def train(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE, lexicon: int = LEXICON, exceptions: tuple[str, ...] = (),
) -> dict:
    """The model, from at most sample labelled rows that are not held out.  exceptions: phrases in which lexicon words are harmless."""
    given = sorted({f for f in (fold(e)[0] for e in exceptions) if f})
    usable = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & (crc_mod(key, 3) != 1))
    chosen = usable.groupBy(F.col(key).alias("key")).agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("key"), "key").limit(sample)
    picked = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    picked = picked.groupBy("key", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text"))
    picked = picked.select("text", F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), F.pmod(F.xxhash64("key", F.lit("half")), F.lit(2)).cast("int").alias("half"))
    picked = written(picked.repartition(SAMPLE_PARTS).mapInArrow(_folded, "folded string, words int, label int, half int"), "op13_sample")
    n = {(r.half, r.label): r["count"] for r in picked.groupBy("half", "label").count().collect()}
    toxic, clean = [n.get((h, 1), 0) for h in (0, 1)], [n.get((h, 0), 0) for h in (0, 1)]
    if not sum(toxic) or not sum(clean):
        return {"empty": True}
    t, c = F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1")
    # phrases first: a word may be harmless in one of them only
    words = _counted(picked, lambda folded, _: WORDS.findall(folded)).select("term", t.alias("n"), c.alias("m"), _weight(t, c, sum(toxic), sum(clean)).alias("weight"))
    likely = [(r.term, r.n, r.m) for r in words.where((F.col("n") >= LEAST_TEXTS) & (F.col("weight") > 0)).orderBy((F.col("n") * F.col("weight")).desc(), "term").limit(lexicon).collect()]
    known = {w for w, _, _ in likely}
    pairs = _counted(picked, lambda folded, _: (f"{a} {b}" for (a, gap), (b, _) in pairwise(TOKENS.findall(folded)) if gap == " " and (a in known or b in known))).select("term", t.alias("n"), c.alias("m"))
    share = F.broadcast(documents.sparkSession.createDataFrame(likely, "word string, toxic long, clean long"))
    pairs = pairs.where((F.col("m") >= LEAST_CLEAN) & (F.col("n") * sum(clean) <= F.col("m") * sum(toxic))).join(share, F.expr("word in (split_part(term, ' ', 1), split_part(term, ' ', 2))"))
    pairs = pairs.where(F.col("m") >= LEAST_SHARE * F.col("clean"))
    # only phrases without which the word would weigh enough
    left = F.greatest(F.col("clean") - F.col("held"), F.lit(0))
    worth = pairs.groupBy("word", "toxic", "clean").agg(F.sum("m").alias("held")).where(_weight(F.col("toxic"), left, sum(toxic), sum(clean)) >= LEAST_WEIGHT).select("word")
    found = pairs.join(F.broadcast(worth), "word").groupBy("term").agg(F.max("m").alias("m")).orderBy(F.col("m").desc(), "term").limit(EXCEPTIONS)
    spared = sorted({*given, *(r.term for r in found.collect())})
    words = written(_counted(picked, lambda folded, use: WORDS.findall(use.without(folded)), lambda: Matcher({}, spared)).where("t0 + t1 > 0"), "op13_words")
    weights = _lexicon(words, t, c, sum(toxic), sum(clean), lexicon)
    # each half's lexicon is for the other one
    halves = [_lexicon(words, F.col(f"t{h}"), F.col(f"c{h}"), toxic[h], clean[h], lexicon) for h in (0, 1)]

    def run(batches):
        import pyarrow as pa

        other = [Matcher(halves[1], spared), Matcher(halves[0], spared)]
        for batch in batches:
            values = [other[h.as_py()].density(x.as_py(), n.as_py())[0] for x, n, h in zip(batch.column(0), batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(3), pa.array(values, pa.float64())], names=["label", "density"])

    seen = picked.select("folded", "words", "half", "label").mapInArrow(run, "label int, density double").toPandas().sort_values(["label", "density"])
    bias, slope = curve(seen["label"].to_numpy(float), seen["density"].to_numpy(float))
    return {"weights": weights, "exceptions": spared, "bias": bias, "slope": slope}


def score(documents: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, n_hits, terms: the distinct folded lexicon words that were hit, in order) of each row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    source = documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        import pyarrow as pa

        model = shared.value
        matcher = None if "empty" in model else Matcher(model["weights"], model["exceptions"])
        for batch in batches:
            scores, n_hits, terms = [], [], []
            for x in batch.column(1):
                density, hits = matcher.density(*fold(x.as_py())) if matcher else (0.0, [])
                z = model["bias"] + model["slope"] * density if matcher else -math.inf
                scores.append(1 / (1 + math.exp(-min(max(z, -700.0), 700.0))) if matcher else 0.0)
                n_hits.append(len(hits))
                terms.append(sorted({word for word, _ in hits}))
            arrays = [batch.column(0), pa.array(scores, pa.float64()), pa.array(n_hits, pa.int64()), pa.array(terms, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "score", "n_hits", "terms"])

    kind = source.schema["key"].dataType.simpleString()
    return source.mapInArrow(run, f"key {kind}, score double, n_hits long, terms array<string>").withColumnRenamed("key", key)


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(documents, train(documents, read_table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_hits")
