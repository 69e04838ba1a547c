"""Queries of patterns of any length in the bases of an alignment."""

from pyspark.sql import functions as F

from reedbank.operators import suffix
from reedbank.plans.fixtures import fx_aln, with_
from reedbank.plans.registry import query
from reedbank.session import stored

#: Narrower than the longest patterns, so that both ways of a search are taken.
WIDTH = 12


def _patterns(rows):
    """A pattern from each sequence: 1 to 40 letters from one of its first places on (fewer where it ends)."""
    return rows.select(F.substring("seq", (F.col("id") % 5 + 1).cast("int"), (F.col("id") % 40 + 1).cast("int")).alias("pattern")).where("pattern <> ''")


_BASE = f"""{with_("fx_aln")}, u AS (SELECT id, replace(aln, '-', '') AS seq, list_filter(range(1, length(aln) + 1), lambda c: substr(aln, c::INT, 1) <> '-') AS cs FROM fx_aln),
p AS (SELECT DISTINCT substr(seq, (id % 5 + 1)::INT, (id % 40 + 1)::INT) AS pattern FROM u WHERE substr(seq, (id % 5 + 1)::INT, (id % 40 + 1)::INT) <> ''),
o AS (SELECT id, seq, cs, unnest(range(1, length(seq) + 1))::INT AS "offset" FROM u),
k AS (SELECT DISTINCT length(pattern)::INT AS n FROM p),
f AS (SELECT pattern, id, "offset", cs["offset"]::INT AS "start", cs["offset" + n - 1]::INT AS "end" FROM o, k JOIN p ON length(pattern) = n WHERE substr(seq, "offset", n) = pattern)"""


def _rows(spark, d):
    """Each row's bases, made once: a search reads them as places, as patterns and to check long patterns."""
    return stored(suffix.ungapped(fx_aln(spark, d)), "bases")


@query(f"{_BASE} SELECT pattern, count(*) AS n FROM f GROUP BY pattern")
def pattern_count(spark, d):
    """How often each pattern stands in the bases of all rows."""
    rows = _rows(spark, d)
    return suffix.count(suffix.places(rows, WIDTH), _patterns(rows), rows, WIDTH)


@query(f'{_BASE} SELECT pattern, id, "start", "end" FROM f')
def pattern_locate(spark, d):
    """All places of each pattern, as columns of the alignment."""
    rows = _rows(spark, d)
    return suffix.locate_columns(suffix.places(rows, WIDTH), _patterns(rows), rows, WIDTH)


@query(f'{_BASE} SELECT pattern, id, "offset" FROM f QUALIFY row_number() OVER (PARTITION BY pattern ORDER BY id, "offset") = 1')
def pattern_first(spark, d):
    """The first place of each pattern."""
    rows = _rows(spark, d)
    return suffix.locate_first(suffix.places(rows, WIDTH), _patterns(rows), rows, WIDTH)


@query(f"{_BASE} SELECT pattern, count(DISTINCT id) AS n_rows FROM f GROUP BY pattern")
def pattern_rows(spark, d):
    """How many rows have each pattern."""
    rows = _rows(spark, d)
    return suffix.count_rows(rows, _patterns(rows), WIDTH)
