"""Operator 6: quality rules as a short-circuit cascade, with Spark expressions only.

Base figures of every text are computed once: words, characters in words, symbols, repeated lines and words in repeated 5-word windows.  Further rules are
estimated on a sample of the whole table (about SAMPLE_ROWS rows, drawn by Spark's sampling): the share that each rejects, and the time that REPEATS
evaluations of it take there, less what the same job takes without a rule.  The cascade asks them in the order of rejection per cost, and a rule is evaluated
only for rows that all rules before it have let through.  The order changes the work, never the verdict.

Repeated windows: hashes of the text's 5-word windows are compared with their distinct values; only texts with fewer distinct values sort (hash,
place) pairs, and the words under windows with an equal neighbour are counted as a union of intervals.

Rows: null and empty texts have no words, and fail.  A null key is kept, repeated rows are each judged.  Other columns are ignored, whatever their names.
Whole texts are used.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm.shared import let, read_table

SPACE = r"[\x20\x09-\x0D]+"
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
SAMPLE_ROWS, REPEATS = 1000, 2


def n_words_in_repeats(word_hashes: Column, w: int = WINDOW) -> Column:
    """Words under w-word windows that are found twice or more in the row; word_hashes: array<long>."""

    def windows(h: Column) -> Column:
        return F.transform(F.slice(h, 1, F.size(h) - (w - 1)), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, w)]))

    def covered(found: Column) -> Column:
        def places(pairs: Column) -> Column:
            twin = lambda x, i: (F.get(pairs, i - 1)["h"] == x["h"]) | (F.get(pairs, i + 1)["h"] == x["h"])
            return F.array_sort(F.transform(F.filter(pairs, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

        def union(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.coalesce(F.least(F.lit(w), b - a), F.lit(w)))
            return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

        pairs = F.array_sort(F.transform(found, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return let(let(pairs, places), union)

    of = lambda found: F.when(F.size(F.array_distinct(found)) == F.size(found), F.lit(0)).otherwise(covered(found))
    return let(word_hashes, lambda h: F.when(F.size(h) <= w, F.lit(0)).otherwise(let(windows(h), of)))


def base_figures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, content, words, base figures): content is the text, never null."""
    out = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("content"))
    out = out.withColumn("words", F.array_remove(F.split("content", SPACE), ""))
    lines = F.filter(F.split("content", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    figures = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.array_join("words", "")),
        "n_symbols": F.regexp_count("content", F.lit(SYMBOLS)),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": n_words_in_repeats(F.transform("words", lambda x: F.xxhash64(x))),
    }
    return out.select("*", *[c.cast("long").alias(k) for k, c in figures.items()])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rules() -> dict[str, Column]:
    """What a text fails by: boolean columns over base_figures."""
    per_word = lambda c: c / F.greatest(F.col("n_words"), F.lit(1))
    longest = F.array_max(F.transform("words", lambda x: F.length(x)))
    return {
        "base": base_failed(),
        "mean_word": ~per_word(F.col("word_chars")).between(2.0, 20.0),
        "symbols": per_word(F.col("n_symbols")) > 0.3,
        # most lines are copies of others
        "repeated_lines": (F.col("n_dup_lines") >= 4) & (F.col("n_dup_lines") > 0.5 * F.size(F.filter(F.split("content", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))),
        "letters": F.regexp_count("content", F.lit(r"\p{L}")) < 0.5 * F.col("word_chars"),
        "long_word": longest > 1000,
        "bullets": F.regexp_count("content", F.lit(r"(?m)^\s*[-*•]")) > 0.9 * F.size(F.split("content", "\n")),
        "ellipses": F.regexp_count("content", F.lit(r"(?m)(\.\.\.|…)\s*$")) > 0.3 * F.size(F.split("content", "\n")),
    }


def cascade_order(sample: DataFrame, of: dict[str, Column]) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds on the sample) by rejection per cost; sample: bounded rows of base_figures, kept in memory."""
    n = max(1, sample.count())
    again = sample.withColumn("again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(rule: Column) -> tuple[int, float]:
        began = time.perf_counter()
        rejected = again.select(F.sum(rule.cast("long"))).first()[0] or 0
        return rejected, time.perf_counter() - began

    # the first job warms up, the second one is what a job takes without a rule
    idle = [timed(F.length("content") < i)[1] for i in (0, -1)][1]
    out = []
    for name, rule in of.items():
        rejected, took = timed(F.coalesce(rule, F.lit(True)))
        out.append((name, rejected / (n * REPEATS), max(took - idle, 1e-4) / REPEATS))
    return sorted(out, key=lambda x: (-x[1] / x[2], x[0]))


def judge(figures: DataFrame, of: dict[str, Column], order: list[str]) -> DataFrame:
    """figures with kept and failed_rule, the first rule in order that rejects the row."""
    failed = F.lit(None).cast("string")
    for name in reversed(order):
        failed = F.when(F.coalesce(of[name], F.lit(True)), F.lit(name)).otherwise(failed)
    return figures.withColumn("failed_rule", failed).withColumn("kept", F.col("failed_rule").isNull())


def quality_cascade(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed_rule, kept) of each row."""
    share = min(1.0, SAMPLE_ROWS / max(1, df.count()))
    sample = base_figures(df.sample(False, share, 7) if share < 1 else df, key, text).persist()
    order = cascade_order(sample, rules())
    sample.unpersist()
    judged = judge(base_figures(df, key, text), rules(), [name for name, _, _ in order])
    return judged.select(F.col("key").alias(key), *FIGURES, base_failed().alias("base_failed"), "failed_rule", "kept")


#: The query leaves out failed_rule, which depends on the order of the rules, and so on measured times.
def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cascade(read_table(spark, sf_dir, "documents")).drop("failed_rule")
