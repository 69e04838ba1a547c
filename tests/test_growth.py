"""What grows with the input is neither broadcast nor read by one task, whatever small files let Spark estimate."""

import contextlib
import io
import re

import pytest
from pyspark.sql import functions as F

from reedbank.operators import msa
from reedbank.session import spread

ROWS = [(1, "AC-T"), (2, "ACGT"), (3, "TC-T"), (4, "A--A"), (5, "----")]


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


@pytest.fixture(scope="module")
def aligned(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("growth") / "aligned")
    spark.createDataFrame(ROWS, "id long, aln string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_spread_deals_by_rows(spark):
    rows = spark.range(0, 1000, 1, 1)
    assert spread(rows, 100).rdd.getNumPartitions() == 10
    assert spread(rows, 1000).rdd.getNumPartitions() == 1
    assert spread(rows, 100).agg(F.sum("id")).first()[0] == 499500


def test_sequence_weights_broadcast_columns_only(spark, aligned):
    """The counts of columns are what is broadcast, whatever Spark estimates; the sites of all rows never."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = msa.sequence_weights(msa.long(aligned))
        assert set(re.findall(r"(\w+Join) \[site.*?(Build\w+)", plan(found))) == {("BroadcastHashJoin", "BuildRight")}
        weights = {r.id: r.weight for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(weights) == [1, 2, 3, 4] and sum(weights.values()) == pytest.approx(4)


@pytest.mark.parametrize("of", [lambda x: x, msa.weighted_fractions], ids=["weighted_counts", "weighted_fractions"])
def test_weights_meet_sites_by_merging(aligned, of):
    sites = msa.long(aligned)
    assert "SortMergeJoin [id" in plan(of(msa.weighted_counts(sites, msa.sequence_weights(sites))))


def test_states_meet_weights_by_merging(aligned):
    """As the counts of a profile are made."""
    sites = msa.long(aligned)
    states = msa.states(sites, msa.match_columns(sites))
    assert "SortMergeJoin [id" in plan(msa.with_weights(states, msa.sequence_weights(sites)))


def test_candidates_meet_node_weights_by_merging(spark):
    from reedbank.kernels.models import jc69
    from reedbank.operators import chimera

    reads = spark.createDataFrame([(1, 2, 1, "A")], "read long, node long, site int, base string")
    weights = spark.createDataFrame([(2, 1, 1.0, 0.0, 0.0, 0.0)], "id long, site int, wa double, wc double, wg double, wt double")
    assert "SortMergeJoin [node" in plan(chimera.site_scores(reads, weights, jc69()))


def test_messages_meet_by_merging(spark):
    from reedbank.kernels.models import jc69
    from reedbank.operators import contraction

    up = spark.createDataFrame([(1, 1, None, 0.0, [1.0] * 4, 0.0), (2, 1, 1, 0.1, [1.0] * 4, 0.0)], "id long, site int, parent long, length double, l array<double>, ls double")
    down = spark.createDataFrame([(2, 1, [1.0] * 4, 0.0)], "id long, site int, d array<double>, ds double")
    text = plan(contraction.state_weights(up, down, jc69()))
    assert "SortMergeJoin [id" in text and "Broadcast" not in text


def test_kmers_meet_reads_by_merging(spark, aligned):
    from reedbank.operators import kmer

    reads = spark.createDataFrame([(7, "ACT")], "read long, seq string")
    found = kmer.seeds(reads, kmer.index(aligned, 3), 3, 3)
    assert "SortMergeJoin [kmer" in plan(found)
    assert [tuple(r) for r in found.collect()] == [(7, 1, 1, 1, 4)]


def test_nodes_meet_parents_by_merging(spark):
    from reedbank.sources.newick import parse_table

    text = plan(parse_table(spark.createDataFrame([(1, "(a,b)c;")], "tree long, text string")))
    assert "SortMergeJoin [tree" in text and "Broadcast" not in text


@pytest.mark.parametrize("of", ["msa", "kmer", "newick"])
def test_rows_are_dealt_before_they_are_widened(spark, aligned, monkeypatch, of):
    """A file of one part is widened by more than one task."""
    import reedbank.session as session
    from reedbank.operators import kmer
    from reedbank.sources import newick

    module = {"msa": msa, "kmer": kmer, "newick": newick}[of]
    monkeypatch.setattr(module, "spread", lambda df: session.spread(df, 2))
    trees = aligned.select(F.col("id").alias("tree"), F.lit("(a,b)c;").alias("text"))
    found = {"msa": lambda: msa.long(aligned), "kmer": lambda: kmer.index(aligned, 2), "newick": lambda: newick.parse_table(trees)}[of]()
    assert "RoundRobinPartitioning(3)" in plan(found)


def test_cells_are_dealt_by_rows_and_totals_multiply_none(spark):
    """Totals by cube expand each row four times before they are grouped."""
    from reedbank.operators import otu

    counts = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (2, 1, 4), (2, 1, 1), (None, 2, 7)], "otu long, sample long, n long")
    found = otu.totals(counts)
    assert "Expand" not in plan(found)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, counts.cube("sample", "otu").agg(F.sum("n")).collect()), key=str)


def test_reads_far_beyond_the_depth_are_not_ranked(spark):
    """What is ranked are reads of the first pieces of the hashes' range; the ones that stay are those of the smallest hashes all the same."""
    import hashlib

    from reedbank.operators import otu

    counts = spark.createDataFrame([(o, s, 40 + o) for o in range(30) for s in (1, 2)] + [(1, 3, 2)], "otu long, sample long, n long")
    found = otu.subset_uniform(counts, 5)
    assert "piece" in plan(found)
    want = {(1, 3): 2}
    for s in (1, 2):
        reads = sorted((hashlib.md5(f"0|{s}|{o}|{i}".encode()).hexdigest(), o, i) for o in range(30) for i in range(1, 41 + o))[:5]
        for _, o, _ in reads:
            want[o, s] = want.get((o, s), 0) + 1
    assert {(r.otu, r.sample): r.n for r in found.collect()} == want


def test_nearest_nodes_take_no_node_to_the_driver(spark, monkeypatch):
    """Ties, gaps in reads and nodes, nodes without a base; blocks of any size give what comparing all pairs gives."""
    import random

    from pyspark.sql import DataFrame

    from reedbank.operators import similarity

    made = random.Random(5)
    text = lambda: "".join(made.choice("ACGT-") for _ in range(6))
    reads, nodes = [(i, text()) for i in range(20)], [(i, text()) for i in range(300)] + [(300, "------"), (301, None)]
    want = []
    for r, a in reads:
        found = []
        for i, b in nodes:
            both = [(x, y) for x, y in zip(a, b or "------") if x != "-" and y != "-"]
            if both:
                found.append((sum(x != y for x, y in both) / len(both), i))
        want += [(r, i, x) for x, i in sorted(found)[:4]]
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda *_, **__: pytest.fail("rows go to the driver"))
    tables = spark.createDataFrame(reads, "read long, seq string"), spark.createDataFrame(nodes, "id long, seq string")
    for size in (1 << 14, 7):
        monkeypatch.setattr(similarity, "NODES_A_BLOCK", size)
        monkeypatch.setattr(similarity, "READS_A_BLOCK", size)
        assert sorted(map(tuple, similarity.nearest_nodes(*tables, 4, 6).collect())) == sorted(want)
