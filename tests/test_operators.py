"""Readers, writers, sampling and other operators on small inputs."""

import gzip

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reedbank.functions import alphabet, sequence
from reedbank.operators import otu
from reedbank.sources import fasta, newick, tables


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.builds(lambda n, v: newick.Tree(n, v), st.text("ab '(),:;", max_size=4), st.one_of(st.none(), st.floats(0, 9).map(lambda x: round(x, 3)))), lambda kids: st.builds(lambda n, c: newick.Tree(n, 1.0, c), st.text("xy", max_size=3), st.lists(kids, min_size=1, max_size=3)), max_leaves=8))
def test_newick_round_trip(tree):
    tree.name = tree.name.strip()
    once = newick.write(tree)
    again = newick.parse(once)
    strip = lambda t: [(a, b, (c or "").strip(), d, e) for a, b, c, d, e in newick.flatten(t)]
    assert [r[1:3] for r in strip(again)] == [r[1:3] for r in strip(tree)]
    assert newick.write(newick.build([r[:4] for r in newick.flatten(again)])) == newick.write(again)


@pytest.mark.parametrize("bad", ["((a,b);", "a,b;", "(a))b;", "('a;"])
def test_newick_errors(bad):
    with pytest.raises(ValueError):
        newick.parse(bad)


def test_parse_table(spark):
    from reedbank.sources.newick import flatten, parse, parse_table

    texts = ["((a:1,b:2)ab:0.5,(c:1.5,'d e':0.25)cd:1)root:0;", "one;", "one:3", "(a,b,(c,(d,e)x,f),'it''s (g);')[note]r", "(,(,));", " ( a b : 1e-3 , [x] b ) ;", "", None, "((((deep))))z;", "(a,b);(c,d);"]
    rows = spark.createDataFrame(list(enumerate(texts)), "tree long, text string")
    got = {}
    for r in parse_table(rows).collect():
        got.setdefault(r.tree, []).append((r.id, r.parent, r.name, r.length, r.is_leaf))
    assert {k: sorted(v) for k, v in got.items()} == {k: flatten(parse(t)) for k, t in enumerate(texts) if t}


@pytest.mark.parametrize("bad", ["(a,b;", "a,b;", "(a,b));", "((a)"])
def test_parse_table_errors(spark, bad):
    from reedbank.sources.newick import parse_table

    with pytest.raises(Exception, match="parentheses"):
        parse_table(spark.createDataFrame([(1, bad)], "tree long, text string")).collect()


def test_fasta_and_fastq_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">r1 first > one\nACg\nTT\n>r2\nGG\n")
    got = [tuple(r) for r in fasta.read_fasta(spark, str(tmp_path / "a.fa")).orderBy("id").collect()]
    assert got == [("r1", "first > one", "ACGTT"), ("r2", "", "GG")]
    with gzip.open(tmp_path / "b.fastq.gz", "wt") as f:
        f.write("@q1 x y\nacgt\n+\nIIII\n@q2\nA\n+\n@\n")
    got = [tuple(r) for r in fasta.read_sequences(spark, str(tmp_path / "b.fastq.gz")).orderBy("id").collect()]
    assert got == [("q1", "x y", "ACGT", "IIII"), ("q2", "", "A", "@")]
    with open(tmp_path / "c.fq", "w") as f:
        f.write("@q3\nCC\n+\nII\n")
    assert fasta.read_fastq(spark, "file://" + str(tmp_path / "c.fq")).first().id == "q3"
    (tmp_path / "d").mkdir()
    (tmp_path / "c.fq").rename(tmp_path / "d" / "c.fq")
    assert fasta.read_fastq(spark, str(tmp_path / "d")).count() == 1
    assert fasta.sniff_format("x/y.FNA".lower() + ".bz2") == "fasta"
    with pytest.raises(ValueError):
        fasta.sniff_format("reads.txt")
    with pytest.raises(ValueError):
        list(fasta.fastq_records(["@a", "ACG", "+", "II"]))


def test_alphabets():
    a = alphabet.NUCLEOTIDE
    assert [a.code(c) for c in "ACGTNRYn-."] == [0, 1, 2, 3, 0, 0, 1, 0, -2, -2] and a.code("*") == -1
    assert a.matches("R", "G") and not a.matches("R", "C") and a.matches("-", ".") and not a.matches("-", "A")
    assert alphabet.alphabet("amino").expand("B") == "DN"


def test_sequence_functions(spark):
    df = spark.createDataFrame([("ACGTN-", "IIII"), ("", None)], "s string, q string")
    r = df.select(sequence.reverse_complement(F.col("s")), sequence.reverse_complement(sequence.reverse_complement(F.col("s"))), sequence.ungap(F.col("s")), sequence.quality_at(F.col("q"), 1), sequence.wrap(F.col("s"), 4)).collect()
    assert list(r[0]) == ["-NACGT", "ACGTN-", "ACGTN", 40, "ACGT\nN-"] and list(r[1]) == ["", "", "", 30, ""]
    fq = df.where("s <> ''").select(sequence.fastq(F.lit("x"), F.lit(""), F.col("s"), F.lit(None).cast("string"))).first()[0]
    assert fq == "@x\nACGTN-\n+\n??????"


COUNTS = [("o1", "a", 30), ("o2", "a", 10), ("o1", "b", 5), ("o3", "c", 50), ("o4", "c", 0)]


@pytest.fixture
def counts(spark):
    return spark.createDataFrame(COUNTS, "otu string, sample string, n long")


@pytest.mark.parametrize("method", ["uniform", "multinomial"])
def test_subset_totals(counts, method):
    f = otu.subset_uniform if method == "uniform" else otu.subset_multinomial
    out = f(counts.where("n > 0"), 20, 3)
    assert {r.sample: r.total for r in otu.sample_totals(out).collect()} == {"a": 20, "b": 5, "c": 20}
    assert {r.sample for r in otu.rarefy(counts.where("n > 0"), 20, method).collect()} == {"a", "c"}
    if method == "uniform":
        assert all(r.n <= dict(((o, s), n) for o, s, n in COUNTS)[r.otu, r.sample] for r in out.collect())


def test_subset_ignores_partitions(counts):
    one, many = (sorted(map(tuple, otu.subset_uniform(counts.where("n > 0").repartition(k), 20).collect())) for k in (1, 7))
    assert one == many


def test_normalise_and_zero_samples(spark, counts):
    out = otu.normalise(counts, 100.0)
    assert {round(r.total, 9) for r in otu.sample_totals(out).collect()} == {100.0}
    zero = spark.createDataFrame([("o", "z", 0)], "otu string, sample string, n long")
    assert otu.normalise(zero, 100.0).first().n == 0.0
    with pytest.raises(ValueError):
        otu.normalise(counts, 1, "other")


def test_merge_keeps_first_taxonomy(spark):
    t = lambda *rows: spark.createDataFrame(list(rows), "otu string, taxonomy string, sample string, n double")
    out = otu.merge(t(("o", "x", "a", 1.0)), t(("o", "y", "a", 2.0), ("p", "z", "b", 3.0)), taxonomy="taxonomy")
    assert sorted(map(tuple, out.select("otu", "sample", "n", "taxonomy").collect())) == [("o", "a", 3.0, "x"), ("p", "b", 3.0, "z")]


def test_otu_table_file(spark, tmp_path):
    long = spark.createDataFrame([("1", "k__A", "s1", 2.0), ("2", "k__B", "s2", 3.0)], "otu string, taxonomy string, sample string, n double")
    tables.write_otu_table(long, str(tmp_path / "t"))
    got = sorted(map(tuple, tables.read_otu_table(spark, str(tmp_path / "t")).collect()))
    assert got == [("1", "k__A", "s1", 2.0), ("1", "k__A", "s2", 0.0), ("2", "k__B", "s1", 0.0), ("2", "k__B", "s2", 3.0)]


def test_program_lines():
    tables.check_program_line(tables.program_line("x"))
    for bad in ("# reedbank v99.0.0", "# other v1", ""):
        with pytest.raises(ValueError):
            tables.check_program_line(bad)


def test_nearest_nodes_in_blocks(spark, monkeypatch):
    from reedbank.operators import similarity

    rows = [(i, "".join("ACGT"[(i * 7 + j * j) % 4] for j in range(12))) for i in range(40)]
    nodes, reads = spark.createDataFrame(rows, "id long, seq string"), spark.createDataFrame(rows[:5], "read long, seq string")
    one = sorted(map(tuple, similarity.nearest_nodes(reads, nodes, 3, 12).collect()))
    monkeypatch.setattr(similarity, "BLOCK_BYTES", 12 * 7)
    assert sorted(map(tuple, similarity.nearest_nodes(reads, nodes, 3, 12).select("read", "node", "dist").collect())) == one
    assert all(d == 0 for r, n, d in one if r == n)


def test_random_leaves_are_leaves_below(spark):
    from reedbank.operators import tree

    nodes = spark.createDataFrame([(i, None if i == 1 else i // 2, 0.1, f"n{i}") for i in range(1, 16)], "id long, parent long, length double, name string")
    got = {r.id: r.leaf for r in tree.random_leaf(nodes, 3).collect()}
    below = lambda i, leaf: leaf == i or (leaf > i and below(i, leaf // 2))
    assert len(got) == 15 and all(8 <= leaf <= 15 and below(i, leaf) for i, leaf in got.items())
    assert got == {r.id: r.leaf for r in tree.random_leaf(nodes.repartition(7), 3).collect()}


def test_pseudo_leaves():
    from reedbank.plans.summarise import with_pseudo_leaves

    rows = [(0, None, "root", None), (1, 0, "a", 1.0), (2, 0, "b", 1.0)]
    assert with_pseudo_leaves(rows, {0, 2}) == [*rows, (3, 0, "root", 0.0)]


def test_deep_trees(spark):
    from reedbank.operators import tree

    nodes = spark.createDataFrame([(i, i - 1 if i else None, 0.5, "x") for i in range(104)], "id long, parent long, length double, name string")
    assert {r.id: r.height for r in tree.heights(nodes).collect()}[0] == 51.5


def test_draws_of_very_large_cells(spark):
    """Reads beyond the numbers of 32 bits are drawn like all others; cells may hold more reads than an int or an array."""
    counts = spark.createDataFrame([(1, "s", 3_000_000_000), (2, "s", 6_000_000_000)], "otu long, sample string, n long")
    got = {r.otu: r.n for r in otu.subset_multinomial(counts, 3000).collect()}
    assert sum(got.values()) == 3000 and abs(got[1] - 1000) < 130
    monkey, otu.READS_AT_ONCE = otu.READS_AT_ONCE, 7
    try:
        rows = otu.reads(spark.createDataFrame([(1, "s", 23), (2, "s", 7), (3, "t", 0)], "otu long, sample string, n long")).collect()
    finally:
        otu.READS_AT_ONCE = monkey
    assert sorted((r.otu, r.i) for r in rows) == [(1, i) for i in range(1, 24)] + [(2, i) for i in range(1, 8)]


def test_models_refuse_bad_rates():
    from reedbank.kernels.models import gtr

    for bad in (-1.0, float("nan"), float("inf")):
        rates = np.ones((4, 4))
        rates[0, 1] = rates[1, 0] = bad
        with pytest.raises(ValueError):
            gtr(np.full(4, 0.25), rates)
