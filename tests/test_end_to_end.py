"""Build, simulate, assign, summarise and export on a small tree; through the command line as well."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from reedbank import cli
from reedbank.kernels.models import hky85
from reedbank.plans import assign, summarise
from reedbank.plans.build import build, profile_counts
from reedbank.sources import database, newick


def grown(depth, name):
    return f"{name}:0.1" if depth == 0 else f"({grown(depth - 1, name + 'a')},{grown(depth - 1, name + 'b')})n{name}:0.08"


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    rng, width = np.random.default_rng(3), 120
    text = grown(3, "x") + ";"
    rows = newick.flatten(newick.parse(text))
    model, seqs = hky85(np.full(4, 0.25), 2.0), {}
    for r in rows:
        seqs[r[0]] = rng.integers(0, 4, width) if r[1] is None else np.array([rng.choice(4, p=model.probability(r[3])[c]) for c in seqs[r[1]]])
    aligned = {r[2]: "".join("ACGT"[c] for c in seqs[r[0]]) for r in rows if r[4]}
    folder = tmp_path_factory.mktemp("world")
    (folder / "msa.fasta").write_text("".join(f">{k}\n{v}\n" for k, v in aligned.items()))
    (folder / "tree.nwk").write_text(text)
    (folder / "tax.tsv").write_text("".join(f"{r[2]}\tk__K; p__{r[2]}\n" for r in rows))
    assert cli.main(["build", f"{folder}/msa.fasta", f"{folder}/tree.nwk", f"{folder}/db", "-a", f"{folder}/tax.tsv", "-s", "HKY85", "-L", "15"], spark) == 0
    return folder, database.load(spark, f"{folder}/db")


def test_counts_from_spark_equal_counts_in_memory(spark):
    from reedbank.kernels.hmm import count_alignment
    from reedbank.operators import msa

    rows = ["ACGTACGT--ACGT", "ACGTAC-T--ACGA", "ACGAACGTA-ACGT", "A-GTACGT--ACGT"]
    df = spark.createDataFrame(list(enumerate(rows)), "id long, aln string")
    weights = {r.id: r.weight for r in msa.sequence_weights(msa.long(df)).collect()}
    a, b = profile_counts(df), count_alignment(rows, [weights[i] for i in range(4)])
    assert np.allclose(a.em, b.em) and np.allclose(a.ei, b.ei) and np.allclose(a.t, b.t) and list(a.columns) == list(b.columns)


def test_ancestors_by_sites(spark, world):
    from reedbank.kernels.likelihood import Tree, ancestral_sequences
    from reedbank.plans.build import ancestral_by_sites

    _, db = world
    tree, rows = db.tree()
    leaves = Tree(tree.parent, tree.length, np.where(np.array([r.is_leaf for r in rows])[:, None], tree.codes, -1).astype(np.int8))
    want = ancestral_sequences(leaves, db.model)
    assert (ancestral_by_sites(spark, leaves, db.model, sites=50) == want).all() and (want == tree.codes).all()


def test_simulated_reads_come_back(spark, world):
    from reedbank.operators.simulate import simulate

    _, db = world
    reads = simulate(spark, db, 24, mean=100, sd=3, seed=1)
    assert sorted(map(tuple, reads.collect())) == sorted(map(tuple, reads.repartition(5).collect()))
    out = assign.assign(reads, db, options=assign.Options(seeds=8, single=True))
    joined = out.join(reads.select("id", F.col("branch_id").alias("true")), "id").collect()
    assert len(joined) == 24 and sum(r.branch_id == r.true for r in joined) >= 14
    table = summarise.otu_table(out.withColumn("sample", F.lit("s")), db.node)
    assert table.agg(F.sum("n")).first()[0] == 24
    assert summarise.consensus(out, db).where(F.length("consensus") == 120).count() == table.count()
    assert assign.detect_strand(reads, db, 12) == 1
    turned = reads.withColumn("seq", assign.reverse_complement(F.col("seq")))
    assert assign.detect_strand(turned, db, 12) == 2
    columns = db.profile.columns[1:]
    assert summarise.filtered(out, 0, 0.5, 0.5, columns).count() == 24 and summarise.filtered(out, 0, 0.5, 1.01, columns).count() == 0


def test_seeds_give_the_same_alignments(spark, world):
    from reedbank.kernels.hmm import Aligner
    from reedbank.operators.simulate import simulate

    _, db = world
    model = assign.model_of(db, assign.Options())
    reads = [r.seq for r in simulate(spark, db, 16, mean=90, sd=4, seed=9).collect()]
    for mode in ("NGCL", "GLOBAL"):
        db.profile.mode = mode
        aligner = Aligner(db.profile)
        seeds = assign.Seeds(db.profile, 15, 50, model[-2][0])
        assert sum(bool(seeds.of(r, mode == "GLOBAL")) for r in reads) > 8
        one, two = assign.align_texts(aligner, reads, 4), assign.align_texts(aligner, reads, 4, seeds)
        assert sum(a.alignment == b.alignment for a, b in zip(one, two, strict=True)) >= 15


def test_command_line(spark, world):
    folder, db = world
    run = lambda *a: cli.main([str(x) for x in a], spark)
    d = f"{folder}/db"
    assert run("sim", d, f"{folder}/reads.fasta", "-N", 12, "-m", 100, "--sd-size", 2) == 0
    assert run("assign", d, f"{folder}/reads.fasta", "-o", f"{folder}/s1.tsv", "--single", "-s", 1, "-N", 6, "-a", f"{folder}/aligned") == 0
    from reedbank.sources.fasta import read_fasta

    aligned = read_fasta(spark, f"{folder}/aligned").collect()
    assert len(aligned) == 12 and all(len(r.seq) == 120 and "csStart=" in r.description for r in aligned)
    assert run("sum", d, f"{folder}/s1.tsv", "-o", f"{folder}/otu", "-r", f"{folder}/lists", "-c", f"{folder}/cons", "-t", f"{folder}/cut", "-p", f"{folder}/pseudo", "--no-gap") == 0
    cons = read_fasta(spark, f"{folder}/cons").collect()
    assert sum(int(r.description.split("ReadCount=")[1].split(";")[0]) for r in cons) == 12 and all("DBName=db;" in r.description and "-" not in r.seq for r in cons)
    assert run("norm", f"{folder}/otu", f"{folder}/norm", "-Z", 100) == 0 and run("subset", f"{folder}/otu", f"{folder}/sub", "-s", 5) == 0
    assert run("merge", f"{folder}/otu", f"{folder}/norm", "-o", f"{folder}/both", "--db", d, "-t", f"{folder}/both.nwk") == 0
    from reedbank.sources.text_models import read_text

    assert newick.flatten(newick.parse(read_text(spark, f"{folder}/both.nwk"))) == newick.flatten(newick.parse(read_text(spark, f"{folder}/cut")))
    from reedbank.sources.tables import read_otu_table

    assert read_otu_table(spark, f"{folder}/both").agg(F.sum("n")).first()[0] == pytest.approx(112)
    assert read_otu_table(spark, f"{folder}/sub").agg(F.sum("n")).first()[0] == 5
    assert run("jplace", d, f"{folder}/s1.tsv", "-o", f"{folder}/x.jplace", "--hmm-iden", 0.2, "-m", "-V", "-a") == 0
    doc = json.loads((folder / "x.jplace").read_text())
    more = doc["metadata"]
    assert more["substitution_model"] == "HKY85" and more["among_site_rate_variation"] == "none" and len(more["node_taxonomy_annotations"]) == db.node.count()
    assert doc["version"] == 3 and len(doc["placements"]) == 12 and "{" in doc["tree"]
    assert run("inspect", d, "-t", f"{folder}/t.nwk", "-a", f"{folder}/a", "-s", f"{folder}/s") == 0
    (folder / "p.fa").write_text(">p1\n" + db.node.where("is_leaf").first().seq[10:30] + "\n")
    assert run("anneal", d, f"{folder}/p.fa", "-o", f"{folder}/prim", "-i", 0.8) == 0
    report = spark.read.options(sep="\t", header=True).csv(f"{folder}/prim")
    assert report.columns == "id description sequence strand CS_start CS_end alignment total_nodes total_leaves hit_nodes hit_leaves efficiency_nodes efficiency_leaves".split()
    found = report.first()
    assert (found.strand, int(found.CS_end) - int(found.CS_start) + 1, found.alignment) == ("1", 20, found.sequence) and int(found.hit_leaves) >= 1
    assert run("train-sm", f"{folder}/msa.fasta", f"{folder}/tree.nwk", "-o", f"{folder}/sm3", "-s", "TN93", "-m", "triplets") == 0
    assert run("train-dm", f"{folder}/msa.fasta", "-o", f"{folder}/dm", "--qM", 2) == 0
    assert run("train-hmm", f"{folder}/msa.fasta", "-o", f"{folder}/hmm", "--dm", f"{folder}/dm") == 0
    assert run("train-sm", f"{folder}/msa.fasta", f"{folder}/tree.nwk", "-o", f"{folder}/sm", "-s", "K80") == 0


def test_stream_equals_batch(spark, world, tmp_path):
    from reedbank.operators.simulate import simulate
    from reedbank.streaming import assign as streaming

    _, db = world
    reads = simulate(spark, db, 8, mean=100, sd=2, seed=5).select("id", F.lit("s").alias("sample"), "seq")
    reads.repartition(2).write.parquet(str(tmp_path / "in"))
    q = streaming.start(streaming.read_stream(spark, str(tmp_path / "in")), db, "stream_counts", str(tmp_path / "cp"), assign.Options(seeds=6, single=True))
    q.processAllAvailable()
    q.stop()
    got = {(r.taxon_id, r.sample): r.n for r in spark.sql("SELECT * FROM stream_counts").collect()}
    out = assign.assign(reads.withColumn("description", F.lit("")), db, options=assign.Options(seeds=6, single=True))
    want = {(r.taxon_id, "s"): r["count"] for r in out.groupBy("taxon_id").count().collect()}
    assert got == want


def test_bad_alignments(spark):
    tree = newick.parse("(a:1,b:1);")
    with pytest.raises(ValueError):
        build(spark, spark.createDataFrame([(0, "a", "AC"), (1, "b", "A")], "id long, name string, aln string"), tree)
    with pytest.raises(ValueError):
        build(spark, spark.createDataFrame([(0, "a", "AC"), (1, "c", "AC")], "id long, name string, aln string"), tree)


def test_large_index_gives_the_same_assignments(spark, world, monkeypatch):
    """Seeds from a join with the index, and from a broadcast table of it."""
    from reedbank.operators.simulate import simulate

    _, db = world
    reads = simulate(spark, db, 10, mean=90, sd=4, seed=4)
    rows = lambda: sorted(map(str, assign.assign(reads, db, options=assign.Options(seeds=6)).collect()))
    one = rows()
    monkeypatch.setattr(assign, "MOST_KMERS", 3)
    assert assign.index_of(db, assign.Options())[0] is None and rows() == one


def test_seeds_of_several_reads(world):
    from reedbank.kernels.likelihood import Placer

    _, db = world
    tree, rows = db.tree()
    placer = Placer(tree, db.model, heights=np.array([r.height for r in rows]), sequences=tree.codes)
    rng = np.random.default_rng(5)
    reads = []
    for _ in range(7):
        a = int(rng.integers(0, 60))
        x = tree.codes[rng.integers(1, len(rows))].copy()
        x[rng.random(len(x)) < 0.2] = -1
        reads.append((x, a, a + int(rng.integers(20, 60))))
    for n, diff, high in ((5, np.inf, np.inf), (50, 0.1, np.inf), (9, np.inf, 0.05)):
        assert placer.seeds_of(reads, n, diff, high) == [placer.seeds(x, a, z, n, diff, high) for x, a, z in reads]


def test_placement_on_covered_columns_only(world):
    """Messages for a stretch of the columns give the same placements there."""
    from reedbank.kernels.likelihood import Placer, Tree

    _, db = world
    tree, rows = db.tree()
    heights = np.array([r.height for r in rows])
    whole = Placer(tree, db.model, heights=heights, sequences=tree.codes)
    part = Placer(Tree(tree.parent, tree.length, tree.codes[:, 20:90]), db.model, heights=heights, sequences=tree.codes[:, 20:90])
    read = tree.codes[9].copy()
    one, two = whole.place(read, 30, 80, 5), part.place(read[20:90], 10, 60, 5)
    assert [(p.child, p.node) for p in one] == [(p.child, p.node) for p in two] and np.allclose([p.loglik for p in one], [p.loglik for p in two])


def test_posterior_consensus(spark):
    """Prior reads by how likely each base is at the node, against a loop over columns."""
    rng = np.random.default_rng(8)
    rows = [(7, j + 1, *(int(x) for x in rng.integers(0, 4, 5))) for j in range(40)]
    weights = [(7, j + 1, *(float(x) for x in rng.dirichlet(np.ones(4)))) for j in range(40)]
    sites = spark.createDataFrame(rows, "otu long, site int, a long, c long, g long, t long, gap long")
    got = summarise.posterior_consensus(sites, spark.createDataFrame(weights, "otu long, site long, wa double, wc double, wg double, wt double"), 1.5).first().consensus
    want = "".join("-" if r[6] > sum(r[2:6]) else "ACGT"[int(np.argmax([n + 1.5 * w for n, w in zip(r[2:6], v[2:], strict=True)]))] for r, v in zip(rows, weights, strict=True))
    assert got == want


def test_node_weights(spark, world):
    from reedbank.kernels.likelihood import Tree, messages, node_message, state_weights

    _, db = world
    tree, rows = db.tree()
    leaf = np.array([r.is_leaf for r in rows])
    bare = Tree(tree.parent, tree.length, np.where(leaf[:, None], tree.codes, -1).astype(np.int8))
    up, down = messages(bare, db.model)
    got = summarise.node_weights(db, spark.createDataFrame([(0,), (3,)], "otu long")).orderBy("otu", "site").collect()
    for i, u in enumerate((0, 3)):
        want = state_weights(node_message(bare, up, down, u, db.model)).T
        assert np.allclose([list(r)[2:] for r in got[i * 120 : (i + 1) * 120]], want) and [r.site for r in got[:120]] == list(range(1, 121))


def test_training_sets(spark):
    from reedbank.plans.build import train_prior, training_pairs, training_triplets

    # ((a, b) tip, (c, (d, e) tip) inner, f) is left out; two children of which one is a tip
    nodes = spark.createDataFrame([(0, None), (1, 0), (2, 0), (3, 1), (4, 1), (5, 2), (6, 2), (7, 6), (8, 6)], "id LONG, parent LONG").withColumn("length", F.lit(0.1))
    near, far = "ACGTACGTACGTACGTACGT", "TTTTTTTTTTTTTTTTTTTT"
    seqs = spark.createDataFrame([(3, near), (4, near[:-1] + "A"), (5, near), (7, near[:-2] + "AT"), (8, far)], "id LONG, aln STRING")
    assert [(r.seq_a, r.seq_b) for r in training_pairs(nodes, seqs).collect()] == [(near, near[:-1] + "A")]
    got = training_triplets(nodes, seqs, 0.9).collect()
    assert {(r.tip, r.id) for r in got} == {(1, 2), (6, 5)} and all(r.seq_a in (near, near[:-2] + "AT") for r in got)
    counts = profile_counts(spark.createDataFrame([(i, x) for i, x in enumerate([near, near[:-1] + "A", near[:4] + "--" + near[6:]])], "id LONG, aln STRING"))
    one, two = train_prior(spark, counts, 2, 1), train_prior(spark, counts, 2, 3)
    assert two.match.cost <= one.match.cost and len(one.match.q) == 2


def test_annotation_walks_up(spark):
    """Against a loop up the tree: full paths end it, partial names are collected, other names are passed."""
    import re

    from reedbank.operators.tree import annotate_by_path

    names = ["k__K;p__P", "g__G", "x", "s__S", "k__K;c__C", "", "k__A; p__B; c__C", "f__F;g__H", "y", "o__O"]
    rows = [(i, (i - 1) // 2 if i else None, names[i % len(names)] if i != 1 else "k__Z", 0.5 + i / 7) for i in range(40)]
    rows += [(100, None, "g__root", 0.0), (101, 100, "x", 1.0), (102, 101, "s__T", 2.0)]
    by = {r[0]: r for r in rows}
    split = lambda x: [p for p in re.split("[;: ]+", x) if p]
    part = lambda x: bool(split(x)) and all(re.match("^[dkpcofgs]__.+", p) for p in split(x))
    full = lambda x: part(x) and all(p[0] == "kpcofgs"[i] or (i == 0 and p[0] == "d") for i, p in enumerate(split(x)))
    want = {}
    for r in rows:
        at, path, far = r, [], 0.0
        while not full(at[2]) and at[1] is not None:
            far += at[3]
            path += [at[2]] * part(at[2])
            at = by[at[1]]
        path += [at[2]] * full(at[2])
        want[r[0]] = (";".join(path[::-1]) if path else "none", round(far, 9))
    df = spark.createDataFrame(rows, "id long, parent long, name string, length double")
    assert {r.id: (r.anno, round(r.anno_dist, 9)) for r in annotate_by_path(df, "none").collect()} == want


def test_split_fastq(spark, tmp_path, monkeypatch):
    """Any cut of a plain file gives all its records once and in order, also where qualities begin with @ or +."""
    from reedbank.sources import fasta

    rng = np.random.default_rng(6)
    letters = list("@+IACGT#")
    records = [(f"r{i}", f"d {i}", "".join(rng.choice(list("ACGT"), n)), "".join(rng.choice(letters, n))) for i, n in enumerate(rng.integers(1, 30, 200))]
    text = "".join(f"@{a} {b}\n{c}\n+\n{d}\n" for a, b, c, d in records)
    path = tmp_path / "x.fastq"
    path.write_text(text)
    for size in (1, 7, 50, 333, 5000):
        got = [r for at in range(0, len(text), size) for r in fasta.fastq_records(fasta._lines_of_split(str(path), at, min(len(text), at + size)))]
        assert got == records, size
    monkeypatch.setattr(fasta, "SPLIT_BYTES", 400)
    reader = fasta.FastqReader(str(path))
    assert len(reader.partitions()) > 10 and [r[:4] for p in reader.partitions() for r in reader.read(p)] == records
    rows = fasta.numbered_sequences(spark, str(path)).orderBy("ordinal").collect()
    assert [(r.ordinal, r.id) for r in rows] == [(i, f"r{i}") for i in range(200)]
    (tmp_path / "x.fasta").write_text("".join(f">r{i}\nAC\nGT\n" for i in range(300)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = fasta.numbered_sequences(spark, str(tmp_path / "x.fasta")).orderBy("ordinal").collect()
        assert [(r.ordinal, r.id, r.seq) for r in rows] == [(i, f"r{i}", "ACGT") for i in range(300)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_alignment_file(spark, tmp_path):
    from reedbank.sources.fasta import read_fasta, write_alignment

    rows = [("a", "AC-T"), ("b", "--GT")]
    write_alignment(spark.createDataFrame(rows, "name string, aln string"), str(tmp_path / "a"))
    assert sorted((r.id, r.seq) for r in read_fasta(spark, str(tmp_path / "a")).collect()) == rows


def test_models_of_other_programs_are_refused(spark, tmp_path):
    from reedbank.sources import text_models

    text_models.save_model(spark, hky85(np.full(4, 0.25), 2.0), str(tmp_path / "m"))
    assert text_models.load_model(spark, str(tmp_path / "m")).kind == "HKY85"
    text = text_models.read_text(spark, str(tmp_path / "m"))
    text_models.write_text(spark, text.replace("# reedbank v", "# reedbank v9"), str(tmp_path / "later"))
    with pytest.raises(ValueError):
        text_models.load_model(spark, str(tmp_path / "later"))
