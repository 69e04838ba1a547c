"""String utilities as column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def characters(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def base_name(path: Column, sep: str = "/") -> Column:
    """What stands behind the last separator."""
    return F.substring_index(path, sep, -1)


def strip_quotes(c: Column, quotes: str = "\"'") -> Column:
    """Without one pair of equal quotes around it."""
    out = c
    for q in quotes:
        out = F.when((F.length(c) >= 2) & F.startswith(c, F.lit(q)) & F.endswith(c, F.lit(q)), F.substring(c, F.lit(2), F.length(c) - 2)).otherwise(out)
    return out


def has_space(c: Column) -> Column:
    return c.rlike(r"\s")


def has_any(c: Column, letters: str) -> Column:
    return F.arrays_overlap(characters(c), F.array(*[F.lit(x) for x in letters]))


def remove_all(c: Column, part: str) -> Column:
    return F.replace(c, F.lit(part), F.lit(""))


def remove_end(c: Column, ending: str) -> Column:
    return F.when(F.endswith(c, F.lit(ending)) & F.lit(bool(ending)), F.substring(c, F.lit(1), F.length(c) - len(ending))).otherwise(c)


def distinct_characters(c: Column) -> Column:
    """Each character once, in order."""
    return F.array_join(F.array_sort(F.array_distinct(characters(c))), "")


def common_characters(a: Column, b: Column) -> Column:
    """Characters that both have, once each, in order."""
    return F.array_join(F.array_sort(F.array_intersect(characters(a), characters(b))), "")
