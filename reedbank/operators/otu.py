"""Algebra of OTU tables in long form: (otu, sample, n), with taxonomy where a table has it.

Tables stay long until the sink, so the number of samples is data, not schema.  A missing (otu, sample) is 0."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reedbank.session import plain_unions, stored

OTU, SAMPLE, N = "otu", "sample", "n"
#: Rows that one task groups into cells.
CELLS_A_TASK = 1 << 19


def count_otus(assignments: DataFrame, otu: str = "taxon_id", keys: Sequence[str] = (SAMPLE,)) -> DataFrame:
    """Reads by OTU and sample: a partial and a final hash aggregate."""
    return assignments.groupBy(F.col(otu).alias(OTU), *keys).agg(F.count("*").alias(N))


def supported(counts: DataFrame, min_reads: int = 0, min_samples: int = 0) -> DataFrame:
    """(otu, reads, samples) of OTUs with enough reads in enough samples."""
    return counts.groupBy(OTU).agg(F.sum(N).alias("reads"), F.count_if(F.col(N) > 0).alias("samples")).where((F.col("reads") >= min_reads) & (F.col("samples") >= min_samples))


def pivot(counts: DataFrame, samples: Sequence, name=lambda s: f"s{s}") -> DataFrame:
    """Wide form with a column for each of samples; absent ones are 0."""
    wide = counts.groupBy(OTU).pivot(SAMPLE, list(samples)).agg(F.sum(N))
    return wide.select(OTU, *[F.coalesce(F.col(f"`{s}`"), F.lit(0)).cast("double").alias(name(s)) for s in samples])


def unpivot(wide: DataFrame, ids: Sequence[str] = (OTU,), keep_zeros: bool = False) -> DataFrame:
    """Long form of a wide table: every column that is not in ids is a sample."""
    samples = [c for c in wide.columns if c not in ids]
    long = wide.unpivot(list(ids), [F.col(f"`{c}`") for c in samples], SAMPLE, N)
    return long if keep_zeros else long.where(F.col(N) != 0)


def densify(counts: DataFrame, otus: DataFrame, samples: DataFrame) -> DataFrame:
    """Every (otu, sample), with 0 where counts has no row; the output is that large by definition."""
    return otus.select(OTU).crossJoin(F.broadcast(samples.select(SAMPLE))).join(counts, [OTU, SAMPLE], "left").select(OTU, SAMPLE, F.coalesce(N, F.lit(0)).alias(N))


def remove_samples(counts: DataFrame, samples: Sequence) -> DataFrame:
    return counts.where(~F.col(SAMPLE).isin(*samples))


def remove_otus(counts: DataFrame, otus: Sequence) -> DataFrame:
    return counts.where(~F.col(OTU).isin(*otus))


def sample_totals(counts: DataFrame) -> DataFrame:
    return counts.groupBy(SAMPLE).agg(F.sum(N).alias("total"))


def totals(counts: DataFrame) -> DataFrame:
    """Totals by (otu, sample), by sample, by otu and over all: null marks what is summed over."""
    plain_unions(counts.sparkSession)
    total = F.sum(N).alias("total")
    # cells are made once, and no row is multiplied before it is grouped
    cells = stored(counts.groupBy(SAMPLE, OTU).agg(total), "otu_cells")
    none = lambda c: F.lit(None).cast(counts.schema[c].dataType).alias(c)
    again = F.sum("total").alias("total")
    by_sample = cells.groupBy(SAMPLE).agg(again).select(SAMPLE, none(OTU), "total")
    by_otu = cells.groupBy(OTU).agg(again).select(none(SAMPLE), OTU, "total")
    over_all = cells.agg(again, F.count("*").alias("rows")).where("rows > 0").select(none(SAMPLE), none(OTU), "total")
    return cells.select(SAMPLE, OTU, "total").unionByName(by_sample).unionByName(by_otu).unionByName(over_all)


def normalise(counts: DataFrame, z: float = 0, method: str = "constant") -> DataFrame:
    """Scale each sample to total z; 0 takes the largest sample total.  A sample with total 0 stays 0."""
    if method != "constant":
        raise ValueError(f"unknown normalisation {method!r}")
    sums = sample_totals(counts)
    if z:
        out = counts.join(sums, SAMPLE)
        return out.select(OTU, SAMPLE, F.coalesce(F.try_divide(F.col(N) * z, F.col("total")), F.lit(0.0)).alias(N))
    top = F.broadcast(sums.agg(F.max("total").alias("top")))
    return counts.join(sums, SAMPLE).crossJoin(top).select(OTU, SAMPLE, F.coalesce(F.try_divide(F.col(N).cast("double") * F.col("top"), F.col("total")), F.lit(0.0)).alias(N))


def prune_samples(counts: DataFrame, least: float) -> DataFrame:
    return counts.join(sample_totals(counts).where(F.col("total") >= least).select(SAMPLE), SAMPLE, "left_semi")


def prune_otus(counts: DataFrame, least: float = 0) -> DataFrame:
    """Drop OTUs with a total under least; with 0, those without any reads."""
    sums = counts.groupBy(OTU).agg(F.sum(N).alias("total"))
    return counts.join(sums.where(F.col("total") >= least if least else F.col("total") > 0).select(OTU), OTU, "left_semi")


def merge(*tables: DataFrame, taxonomy: str | None = None) -> DataFrame:
    """Sum of tables; a taxonomy comes from the first table that has the OTU."""
    plain_unions(tables[0].sparkSession)
    named = [t.withColumn("__table", F.lit(i)) for i, t in enumerate(tables)]
    both = named[0]
    for t in named[1:]:
        both = both.unionByName(t)
    out = both.groupBy(OTU, SAMPLE).agg(F.sum(N).alias(N))
    if taxonomy is None:
        return out
    return out.join(both.groupBy(OTU).agg(F.min_by(taxonomy, F.struct("__table", taxonomy)).alias(taxonomy)), OTU)


def is_relative(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.bool_and(F.col(N) <= 1), F.lit(True)).alias("is_relative"))


def _draw(*parts) -> Column:
    """A number that depends on its arguments alone, however rows are partitioned."""
    return F.md5(F.concat_ws("|", *parts))


READS_AT_ONCE = 1 << 20


def reads(counts: DataFrame, *more: str) -> DataFrame:
    """One row for each read, numbered from 1 in its cell, with more columns of the cell."""
    n, piece = F.col(N).cast("long"), F.lit(READS_AT_ONCE)
    # a cell may have more reads than an array has room for
    starts = counts.where(F.col(N) >= 1).select(OTU, SAMPLE, *more, n.alias("upto"), F.explode(F.sequence(F.lit(0).cast("long"), n - 1, piece.cast("long"))).alias("start"))
    return starts.select(OTU, SAMPLE, *more, F.explode(F.sequence(F.col("start") + 1, F.least(F.col("start") + piece, F.col("upto")))).alias("i"))


def subset_uniform(counts: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """depth reads of each sample without replacement: the ones with the smallest hashes.  Samples with no more reads stay as they are.

    A sample's hashes are counted in pieces of their range that hold about 4 * depth reads each, which tells in which piece the last read that stays lies; so only reads
    up to it are ranked, and those beyond are never sorted."""
    plain_unions(counts.sparkSession)
    cells = stored(counts.select(OTU, SAMPLE, N), "otu_cells")
    # samples are fewer than cells, and no side is sorted
    cells = cells.join(sample_totals(cells).hint("shuffle_hash"), SAMPLE)
    large = cells.where(F.col("total") > depth).withColumn("pieces", F.greatest(F.lit(1), F.floor(F.col("total") / (4 * max(depth, 1)))).cast("long"))
    small = cells.where(F.col("total") <= depth)
    drawn = lambda df, *more: reads(df, "pieces", *more).withColumn("h", _draw(F.lit(seed), SAMPLE, OTU, "i")).withColumn("piece", F.shiftright(F.conv(F.substring("h", 1, 8), 16, 10).cast("long") * F.col("pieces"), 32))
    upto = F.sum("times").over(Window.partitionBy(SAMPLE).orderBy("piece").rowsBetween(Window.unboundedPreceding, 0))
    sizes = drawn(large).groupBy(SAMPLE, "piece").agg(F.count("*").alias("times")).withColumn("before", upto - F.col("times"))
    last = sizes.where(F.col("before") < depth).groupBy(SAMPLE).agg(F.max("piece").alias("last"))
    near = drawn(large.join(last.hint("shuffle_hash"), SAMPLE), "last").where(F.col("piece") <= F.col("last"))
    order = Window.partitionBy(SAMPLE).orderBy("h", OTU, "i")
    kept = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= depth).groupBy(OTU, SAMPLE).agg(F.count("*").alias(N))
    return kept.unionByName(small.select(OTU, SAMPLE, F.col(N).cast("long").alias(N)))


def subset_multinomial(counts: DataFrame, depth: int, seed: int = 0) -> DataFrame:
    """depth draws of each sample with replacement; samples with no more reads stay as they are.

    Draw k of a sample takes the read whose number is a hash of (seed, sample, k), 60 bits of it, modulo the total.  Draws and cells stand in one order of read
    numbers, a cell by its first, and a draw belongs to the last cell before it; so a sample's work is a sort of its cells and draws."""
    plain_unions(counts.sparkSession)
    upto = Window.partitionBy(SAMPLE).orderBy(OTU).rowsBetween(Window.unboundedPreceding, 0)
    whole = F.col(N).cast("long")
    cells = counts.where(F.col(N) > 0).select(OTU, SAMPLE, whole.alias(N), F.sum(whole).over(upto).alias("upto"), F.sum(whole).over(Window.partitionBy(SAMPLE)).alias("total"))
    large, small = cells.where(F.col("total") > depth), cells.where(F.col("total") <= depth)
    number = F.conv(F.substring(_draw(F.lit(seed), SAMPLE, "k"), 1, 15), 16, 10).cast("long")
    draws = large.select(SAMPLE, "total").distinct().select(SAMPLE, "total", F.explode(F.sequence(F.lit(1), F.lit(depth))).alias("k"))
    both = large.select(SAMPLE, (F.col("upto") - F.col(N)).alias("at"), F.lit(0).alias("is_draw"), OTU)
    both = both.unionByName(draws.select(SAMPLE, F.pmod(number, F.col("total")).alias("at"), F.lit(1).alias("is_draw"), F.lit(None).cast(counts.schema[OTU].dataType).alias(OTU)))
    cell = F.last(OTU, ignorenulls=True).over(Window.partitionBy(SAMPLE).orderBy("at", "is_draw").rowsBetween(Window.unboundedPreceding, 0))
    found = both.withColumn(OTU, cell).where("is_draw = 1").groupBy(OTU, SAMPLE).agg(F.count("*").alias(N))
    return found.unionByName(small.select(OTU, SAMPLE, N))


def rarefy(counts: DataFrame, depth: int, method: str = "uniform", seed: int = 0) -> DataFrame:
    """Subset, drop samples below depth, drop empty OTUs."""
    if method not in ("uniform", "multinomial"):
        raise ValueError(f"unknown method {method!r}")
    out = (subset_uniform if method == "uniform" else subset_multinomial)(counts, depth, seed)
    return prune_otus(prune_samples(out, depth))


def site_summary(sites: DataFrame, width: int | None = None) -> DataFrame:
    """(otu, observed_sites, symbol_sites, observed_fraction, symbol_fraction) of site_counts: sites with any read, sites with a base, and their shares of width (the
    number of sites that stand in the table, where it is not given)."""
    bases = F.col("a") + F.col("c") + F.col("g") + F.col("t")
    sums = sites.groupBy(OTU).agg(F.count_if(bases + F.col("gap") > 0).alias("observed_sites"), F.count_if(bases > 0).alias("symbol_sites"), F.count("*").alias("all"))
    n = F.col("all") if width is None else F.lit(width)
    return sums.select(OTU, "observed_sites", "symbol_sites", (F.col("observed_sites") / n).alias("observed_fraction"), (F.col("symbol_sites") / n).alias("symbol_fraction"))


def summary(counts: DataFrame) -> DataFrame:
    """(otu, n_reads, n_samples) of every OTU."""
    return counts.groupBy(OTU).agg(F.sum(N).alias("n_reads"), F.count_if(F.col(N) > 0).alias("n_samples"))


def read_lists(assignments: DataFrame, otu: str, read: str) -> DataFrame:
    """(otu, read_ids): ids in order, with blanks between."""
    return assignments.groupBy(F.col(otu).alias(OTU)).agg(F.array_join(F.array_sort(F.collect_list(F.col(read))), " ").alias("read_ids"))


def site_counts(aligned: DataFrame, otu: str, seq: str) -> DataFrame:
    """(otu, site, a, c, g, t, gap): anything that isn't a base counts as a gap.

    One row a site of every read meets a hash aggregate in the same task, so what is shuffled are partial counts."""
    sites = aligned.select(F.col(otu).alias(OTU), F.posexplode(F.split(F.upper(F.col(seq)), "")).alias("site", "b"))
    of = lambda x: F.count_if(F.col("b") == x)
    return sites.groupBy(OTU, F.col("site") + 1).agg(of("A").alias("a"), of("C").alias("c"), of("G").alias("g"), of("T").alias("t"), F.count_if(~F.col("b").isin("A", "C", "G", "T")).alias("gap")).withColumnRenamed("(site + 1)", "site")


def consensus(sites: DataFrame, prior: Sequence[float] = (0.25, 0.25, 0.25, 0.25), weight: float = 0.0) -> DataFrame:
    """(otu, consensus): by site the base with most counts plus weighted prior, first in A, C, G, T among equals; a gap where gaps outnumber bases."""
    scores = [F.col(b) + F.lit(weight * p) for b, p in zip("acgt", prior, strict=True)]
    best = F.greatest(*scores)
    base = F.when(F.col("gap") > F.col("a") + F.col("c") + F.col("g") + F.col("t"), F.lit("-"))
    for b, s in zip("ACGT", scores, strict=True):
        base = base.when(s == best, F.lit(b))
    rows = sites.select(OTU, F.struct("site", base.alias("b")).alias("x"))
    return rows.groupBy(OTU).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["b"]), "").alias("consensus"))
