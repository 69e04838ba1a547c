"""Operator 11: fill-in-the-middle, a transformation of training texts.

A text is cut into units: white space with the word behind it, or white space alone.  Two places among the units, drawn from a digest of seed and key, split the
text in prefix, middle and suffix, which are written with marks in one of two orders (psm: prefix, suffix, middle; spm: suffix, prefix, middle) or left as they are (plain).
A text that holds a mark stays plain, so the first mark of each kind in an output is the template's and the text can be rebuilt from output and form alone.

The work is a pandas UDF over Arrow batches, row by row and without a shuffle: finditer collects the units' ends in an array of 64-bit integers, two lookups in it give the slices.

Rows: a null text is empty and stays plain.  A null key draws with the word null.  The draw depends on seed and key only, so repeated rows come out alike.  Other columns are
ignored, whatever their names.  Whole texts are used; memory follows the longest one (its units' ends take 8 bytes each).
"""

from __future__ import annotations

import hashlib
from array import array

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reedbank.llm.shared import read_table

SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNITS = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MADE = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def draws(seed: int, key: str) -> tuple[int, int, int, int]:
    """Four unsigned numbers of 32 bits."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).digest()
    return tuple(int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4))


def unit_ends(text: str, units) -> array:
    return array("q", (m.end() for m in units.finditer(text)))


def transform(text: str, key: str, units, seed: int, rate: int, spm_rate: int) -> tuple:
    """(n, form, prefix characters, middle characters, output) of one text."""
    ends = unit_ends(text, units)
    n = len(ends)
    one, two, use, order = draws(seed, key)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or use % 100 >= rate:
        return n, "plain", None, None, text
    first, last = sorted((one % (n + 1), two % (n + 1)))
    start, end = (ends[first - 1] if first else 0), (ends[last - 1] if last else 0)
    prefix, middle, suffix = text[:start], text[start:end], text[end:]
    if order % 100 < spm_rate:
        return n, "spm", start, end - start, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", start, end - start, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text that output was made from."""
    if form == "plain":
        return output
    head, _, middle = output.partition(MIDDLE)
    if form == "psm":
        prefix, _, suffix = head.removeprefix(PREFIX).partition(SUFFIX)
    else:
        suffix, _, prefix = head.removeprefix(SUFFIX).partition(PREFIX)
    return prefix + middle + suffix


def made(text: Column, key: Column, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Column:
    """A struct (n, form, prefix_chars, middle_chars, output, output_sha256); rate and spm_rate are in percent."""

    @F.pandas_udf(MADE)
    def run(texts: pd.Series, keys: pd.Series) -> pd.DataFrame:
        import regex

        units = regex.compile(UNITS)
        rows = [transform(t or "", k, units, seed, rate, spm_rate) for t, k in zip(texts, keys, strict=True)]
        out = pd.DataFrame(rows, columns=["n", "form", "prefix_chars", "middle_chars", "output"])
        out["prefix_chars"], out["middle_chars"] = out["prefix_chars"].astype("Int64"), out["middle_chars"].astype("Int64")
        out["output_sha256"] = [hashlib.sha256(o.encode()).hexdigest() for o in out["output"]]
        return out

    return run(text, F.coalesce(key.cast("string"), F.lit("null")))


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form was made from."""

    @F.pandas_udf("string")
    def run(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([rebuild(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output, form)


def digest(text: Column) -> Column:
    """Lower-case hex of a text's SHA-256 in UTF-8."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([hashlib.sha256(t.encode()).hexdigest() for t in texts], dtype=object)

    return run(text)


def fill_in_middle(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """(key, n, form, prefix_chars, middle_chars, output, output_sha256) of each row."""
    own = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    out = own.select("key", made(F.col("text"), F.col("key"), seed, rate, spm_rate).alias("made"))
    return out.select(F.col("key").alias(key), "made.*")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fill_in_middle(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))
