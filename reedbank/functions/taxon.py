"""Taxon names: ranks with prefixes such as p__, joined by semicolons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rank prefixes from domain to species.
RANKS = ("d__", "k__", "p__", "c__", "o__", "f__", "g__", "s__")
CANONICAL = "^[dkpcofgs]__.+$"
SEPARATORS = "[;: ]+"


def parts(name: Column) -> Column:
    return F.filter(F.split(name, SEPARATORS), lambda x: x != "")


def is_canonical(part: Column) -> Column:
    return part.rlike(CANONICAL)


def is_fully_canonical(name: Column) -> Column:
    return (F.size(parts(name)) > 0) & F.forall(parts(name), is_canonical)


def is_partly_canonical(name: Column) -> Column:
    return F.exists(parts(name), is_canonical)


def is_canonical_list(name: Column) -> Column:
    """Whether all parts are canonical, of whatever ranks."""
    return (F.size(parts(name)) > 0) & F.forall(parts(name), is_canonical)


def is_full_path(name: Column) -> Column:
    """Whether the parts are canonical and go down the ranks from the first one (domain or kingdom) without a gap."""
    at = lambda x, i: is_canonical(x) & F.when(i == 0, F.substring(x, 1, 1).isin("d", "k")).otherwise(F.substring(x, 1, 1) == F.substring(F.lit("kpcofgs"), i + 1, F.lit(1)))
    return (F.size(parts(name)) > 0) & F.forall(F.transform(parts(name), at), lambda x: x)


def canonical(name: Column) -> Column:
    """The canonical parts, joined by semicolons."""
    return F.array_join(F.filter(parts(name), is_canonical), ";")


def with_other(name: Column, distance: Column, most: float = float("inf")) -> Column:
    return F.when(distance > most, F.concat(name, F.lit(";Other"))).otherwise(name)


def branch_id(child: Column, parent: Column) -> Column:
    return F.concat(child.cast("string"), F.lit("->"), parent.cast("string"))


def parse_branch_id(branch: Column) -> tuple[Column, Column]:
    """(child, parent); null where the text isn't a branch."""
    part = lambda i: F.regexp_extract(branch, r"^(-?\d+)->(-?\d+)$", i).try_cast("long")
    return part(1), part(2)
