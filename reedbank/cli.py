"""One sub-command for each program: python -m reedbank.cli NAME ..."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from reedbank import __version__
from reedbank.plans.assign import Options
from reedbank.session import session


def _flag(parser, *names, **more):
    parser.add_argument(*names, **more)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="reedbank", description="Taxonomic assignment of amplicon reads by alignment and placement on a tree")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="program", required=True)
    add = lambda name, text: sub.add_parser(name, help=text)

    p = add("build", "alignment and tree to a database")
    for x in ("msa", "tree", "db"):
        p.add_argument(x)
    _flag(p, "-f", "--symfrac", type=float, default=0.5)
    _flag(p, "-a", "--anno")
    _flag(p, "--dm", help="Dirichlet priors")
    _flag(p, "-s", "--sub-model", default="GTR", choices=("GTR", "TN93", "HKY85", "F81", "K80", "JC69"))
    _flag(p, "--sm", help="file of a trained substitution model")
    _flag(p, "-V", "--var", action="store_true", help="rates that vary over sites")
    _flag(p, "-k", type=int, default=4)
    _flag(p, "-L", "--seed-len", type=int, default=20)

    p = add("assign", "reads to assignments")
    p.add_argument("db")
    p.add_argument("reads")
    p.add_argument("mates", nargs="?")
    _flag(p, "-o", "--output", required=True)
    _flag(p, "--fmt")
    _flag(p, "--single", action="store_true")
    _flag(p, "-s", "--strand", type=int, default=0)
    _flag(p, "-t", "--test", type=int, default=100)
    _flag(p, "-N", type=int, default=50, help="seeds")
    _flag(p, "-d", "--max-diff", type=float, default=float("inf"))
    _flag(p, "-H", "--max-height", type=float, default=float("inf"))
    _flag(p, "-e", "--err", type=float, default=20.0)
    _flag(p, "-m", "--method", default="unweighted", choices=("weighted", "unweighted"))
    _flag(p, "--ML", action="store_true")
    _flag(p, "--prior", default="uniform", choices=("uniform", "height"))
    _flag(p, "-C", "--chimera", action="store_true")
    _flag(p, "--num-segment", type=int, default=2)
    _flag(p, "--chimera-err", type=float)
    _flag(p, "--chimera-lod", type=float, default=0.0)
    _flag(p, "--chimera-out")
    _flag(p, "-a", "--align-out", help="alignments as FASTA")
    _flag(p, "--align-only", action="store_true")

    p = add("sum", "assignments to an OTU table")
    p.add_argument("db")
    p.add_argument("files", nargs="+")
    _flag(p, "-o", "--output", required=True)
    _flag(p, "-r", "--read-lists")
    _flag(p, "-l", "--list", help="sample names of files")
    _flag(p, "-c", "--consensus")
    _flag(p, "-t", "--tree")
    _flag(p, "-p", "--pseudo-tree", help="tree in which inner OTUs have leaves")
    _flag(p, "--no-gap", action="store_true", help="consensus without gaps")
    _flag(p, "-q", type=float, default=0)
    _flag(p, "--aln-iden", type=float, default=0)
    _flag(p, "--hmm-iden", type=float, default=0)
    _flag(p, "-e", "--effN", type=float, default=2)
    _flag(p, "-n", type=int, default=0)
    _flag(p, "-s", type=int, default=0)

    p = add("inspect", "describe a database")
    p.add_argument("db")
    _flag(p, "-t", "--tree")
    _flag(p, "-a", "--anno")
    _flag(p, "-s", "--seq")
    _flag(p, "-n", "--node", action="store_true", help="all nodes, not only leaves")

    p = add("anneal", "primer efficiencies over the tree's nodes")
    p.add_argument("db")
    p.add_argument("primers")
    _flag(p, "-o", "--output", required=True)
    _flag(p, "-i", "--identity", type=float, default=0.9)

    p = add("sim", "simulate reads")
    for x in ("db", "output"):
        p.add_argument(x)
    _flag(p, "-N", type=int, required=True)
    _flag(p, "-k", "--keep-gap", action="store_true")
    _flag(p, "-d", "--max-dist", type=float, default=float("inf"))
    _flag(p, "-m", "--mean-size", type=float, default=500)
    _flag(p, "--sd-size", type=float, default=30)
    _flag(p, "-l", "--min-size", type=int, default=1)
    _flag(p, "-u", "--max-size", type=int, default=0)
    _flag(p, "-r", "--read-len", type=int, default=-1)
    _flag(p, "-R", "--region")
    _flag(p, "--prefix", default="r")
    _flag(p, "-S", "--seed", type=int, default=0)

    for name, text in (("subset", "rarefy an OTU table"), ("norm", "normalise an OTU table")):
        p = add(name, text)
        p.add_argument("input")
        p.add_argument("output")
        if name == "subset":
            _flag(p, "-s", "--size", type=int, required=True)
            _flag(p, "--method", default="uniform", choices=("uniform", "multinomial"))
            _flag(p, "-S", "--seed", type=int, default=0)
        else:
            _flag(p, "-Z", type=float, default=0)
            _flag(p, "--method", default="constant")

    p = add("merge", "merge OTU tables")
    p.add_argument("tables", nargs="+")
    _flag(p, "-o", "--output", required=True)
    _flag(p, "--db", help="database whose tree is cut to the merged OTUs")
    _flag(p, "-t", "--tree")

    p = add("jplace", "assignments to jplace JSON")
    p.add_argument("db")
    p.add_argument("files", nargs="+")
    _flag(p, "-o", "--output", required=True)
    _flag(p, "-q", type=float, default=0)
    _flag(p, "--aln-iden", type=float, default=0)
    _flag(p, "--hmm-iden", type=float, default=0)
    _flag(p, "-m", "--show-model", action="store_true")
    _flag(p, "-V", "--show-var", action="store_true")
    _flag(p, "-a", "--show-anno", action="store_true")

    p = add("train-dm", "train Dirichlet priors")
    p.add_argument("msa")
    _flag(p, "-o", "--output", required=True)
    _flag(p, "--qM", type=int, default=5)
    _flag(p, "-f", "--symfrac", type=float, default=0.5)
    _flag(p, "-n", type=int, default=1, help="starts")
    _flag(p, "--pri-rate", type=float, default=0.05, help="weight of a prior of one row")

    p = add("train-hmm", "train a profile")
    p.add_argument("msa")
    _flag(p, "-o", "--output", required=True)
    _flag(p, "-f", "--symfrac", type=float, default=0.5)
    _flag(p, "--dm")

    p = add("train-sm", "train a substitution model")
    for x in ("msa", "tree"):
        p.add_argument(x)
    _flag(p, "-o", "--output", required=True)
    _flag(p, "-s", "--sub-model", default="GTR", choices=("GTR", "TN93", "HKY85", "F81", "K80", "JC69"))
    _flag(p, "-m", "--method", default="pairs", choices=("pairs", "triplets"))
    return top


def read_alignment(spark, path):
    """(id, name, aln) of an aligned FASTA file; ids follow the names' order."""
    from pyspark.sql import Window

    from reedbank.sources.fasta import read_fasta

    rows = read_fasta(spark, path).select(F.col("id").alias("name"), F.col("seq").alias("aln"))
    # a reference alignment is bounded: its rows are numbered once
    return rows.select((F.row_number().over(Window.orderBy("name")) - 1).cast("long").alias("id"), "name", "aln")


def main(argv: list[str] | None = None, spark=None) -> int:
    o = parser().parse_args(argv)
    spark = spark or session()
    return {
        "build": _build, "assign": _assign, "sum": _sum, "inspect": _inspect, "anneal": _anneal, "sim": _sim, "subset": _subset,
        "norm": _norm, "merge": _merge, "jplace": _jplace, "train-dm": _train_dm, "train-hmm": _train_hmm, "train-sm": _train_sm,
    }[o.program](spark, o) or 0


def _prior(spark, path):
    from reedbank.kernels.dirichlet import Prior
    from reedbank.sources.text_models import load_prior

    return load_prior(spark, path) if path else Prior.flat()


def _build(spark, o):
    from reedbank.plans.build import build
    from reedbank.sources.newick import parse
    from reedbank.sources.tables import read_taxonomy
    from reedbank.sources.text_models import load_model, read_text

    taxonomy = {r.name: r.anno for r in read_taxonomy(spark, o.anno).orderBy("line").toLocalIterator()} if o.anno else None
    model = load_model(spark, o.sm) if o.sm else o.sub_model
    build(spark, read_alignment(spark, o.msa), parse(read_text(spark, o.tree)), taxonomy, _prior(spark, o.dm), model, o.k if o.var else 0, o.symfrac, o.seed_len).save(o.db)


def _assign(spark, o):
    from reedbank.functions.sequence import alignment_description, fasta
    from reedbank.plans import assign
    from reedbank.sources.database import load
    from reedbank.sources.fasta import numbered_sequences, read_sequences
    from reedbank.sources.tables import write_assignments

    db = load(spark, o.db)
    options = Options(
        seeds=o.N, max_diff=o.max_diff, max_height=o.max_height, max_error=o.err, method=o.method, prior=o.prior, ml=o.ML, chimera=o.chimera, segments=o.num_segment,
        chimera_error=o.chimera_err, chimera_lod=o.chimera_lod, single=o.single, align_only=o.align_only,
    )
    reads, mates = read_sequences(spark, o.reads, o.fmt), None
    if o.mates:
        reads, mates = numbered_sequences(spark, o.reads, o.fmt), numbered_sequences(spark, o.mates, o.fmt)
    strand = o.strand or assign.detect_strand(reads, db, o.test)
    if not strand:
        print("the reads' strand can't be told; give -s", file=sys.stderr)
        return 1
    out = assign.assign(reads, db, mates, options, strand)
    if o.chimera and o.chimera_out:
        out = out.persist()
        write_assignments(out.where(F.coalesce("is_chimera", F.lit(False))), o.chimera_out)
        out = out.where(~F.coalesce("is_chimera", F.lit(False)))
    if o.align_out:
        aligned = out.where("alignment is not null")
        aligned.select(fasta(F.col("id"), alignment_description(F.col("description"), F.col("CS_start"), F.col("CS_end")), F.col("alignment"))).write.mode("overwrite").text(o.align_out)
    write_assignments(out, o.output)
    return 0



def _sum(spark, o):
    from reedbank.operators import otu
    from reedbank.operators.assignment import rename_samples
    from reedbank.plans import summarise
    from reedbank.sources.database import load
    from reedbank.sources.newick import build, write
    from reedbank.sources.tables import read_assignments, read_samples, write_otu_table
    from reedbank.sources.text_models import write_text

    db = load(spark, o.db)
    rows = summarise.filtered(read_assignments(spark, o.files), o.q, o.aln_iden, o.hmm_iden, db.profile.columns[1:])
    rows = rows.withColumn("file", F.regexp_extract("file", r"([^/]+?)(/part-[^/]*)?$", 1))
    rows = rename_samples(rows, read_samples(spark, o.list)) if o.list else rows.withColumnRenamed("file", "sample")
    table = summarise.otu_table(rows, db.node, o.n, o.s)
    write_otu_table(table, o.output)
    kept = table.select(F.col("otu").alias("taxon_id")).distinct()
    own = rows.join(kept, "taxon_id", "left_semi")
    if o.read_lists:
        otu.read_lists(own, "taxon_id", "id").write.mode("overwrite").options(sep="\t", header=True).csv(o.read_lists)
    if o.consensus:
        from reedbank.functions.sequence import fasta

        lines = summarise.consensus(own, db, o.effN).join(summarise.otu_descriptions(table, db.node, o.db.rstrip("/").rpartition("/")[2]), "otu")
        text = F.regexp_replace("consensus", "-", "") if o.no_gap else F.col("consensus")
        lines.select(fasta(F.col("otu").cast("string"), F.col("description"), text)).write.mode("overwrite").text(o.consensus)
    if o.tree or o.pseudo_tree:
        names = db.node.select("id", "name")
        cut = [(r.id, r.parent, r.name, r.length) for r in summarise.otu_tree(table, db.node).join(names, "id").toLocalIterator()]
        if o.tree:
            write_text(spark, write(build(cut)), o.tree)
        if o.pseudo_tree:
            otus = {r.otu for r in table.select("otu").distinct().toLocalIterator()}
            write_text(spark, write(build(summarise.with_pseudo_leaves(cut, otus))), o.pseudo_tree)


def _inspect(spark, o):
    from reedbank.functions.sequence import fasta
    from reedbank.operators import tree
    from reedbank.sources.database import load
    from reedbank.sources.newick import build, write
    from reedbank.sources.text_models import write_text

    db = load(spark, o.db)
    s = tree.summary(db.node).first()
    print(f"nodes {s.n_nodes}, edges {s.n_edges}, leaves {s.n_leaves}, columns {db.profile.width}, profile {db.profile.size}, model {db.model.kind}")
    chosen = db.node if o.node else db.node.where("is_leaf")
    if o.tree:
        write_text(spark, write(build([(r.id, r.parent, r.name, r.length) for r in db.node.toLocalIterator()])), o.tree)
    if o.anno:
        chosen.select("id", "anno").write.mode("overwrite").options(sep="\t").csv(o.anno)
    if o.seq:
        chosen.select(fasta(F.col("id").cast("string"), F.col("anno"), F.col("seq"))).write.mode("overwrite").text(o.seq)


def _anneal(spark, o):
    from reedbank.kernels.hmm import Aligner
    from reedbank.operators.similarity import primer_hits
    from reedbank.plans.assign import align_texts
    from reedbank.sources.database import load
    from reedbank.sources.fasta import read_fasta

    db = load(spark, o.db)
    db.profile.mode = "LOCAL"
    primers = [(r.id, r.description, r.seq) for r in read_fasta(spark, o.primers).toLocalIterator()]
    back = str.maketrans("ACGTUMRWSYKVHDBN", "TGCAAKYWSRMBDHVN")
    rows = []
    for name, description, seq in primers:
        ways = [seq, seq[::-1].translate(back)]
        found = [(a.cost, strand, way, a) for strand, (way, a) in enumerate(zip(ways, align_texts(Aligner(db.profile), ways, 1), strict=True), 1) if a is not None]
        if found:
            _, strand, way, a = min(found, key=lambda x: x[:2])
            rows.append((name, description, seq, strand, a.cs_start, a.cs_end, a.alignment[a.cs_start - 1 : a.cs_end], way, a.cs_start - (a.seq_start - 1)))
    table = spark.createDataFrame(rows, "primer string, description string, sequence string, strand int, CS_start int, CS_end int, alignment string, seq string, start int").where("start >= 1")
    hits = primer_hits(table.select("primer", "seq", "start"), db.node.select("id", F.col("seq").alias("aln"), "is_leaf"), o.identity)
    report = table.drop("seq", "start").join(hits, "primer").withColumnRenamed("primer", "id")
    report.write.mode("overwrite").options(sep="\t", header=True).csv(o.output)


def _sim(spark, o):
    from reedbank.functions.sequence import fasta
    from reedbank.operators.simulate import simulate
    from reedbank.sources.database import load
    from reedbank.sources.tables import read_regions

    db = load(spark, o.db)
    regions = [(r.start, r.end) for r in read_regions(spark, o.region, db.profile.width).toLocalIterator()] if o.region else None
    reads = simulate(spark, db, o.N, o.mean_size, o.sd_size, max(1, o.min_size), o.max_size or None, o.read_len, o.max_dist, o.keep_gap, regions, o.prefix, o.seed)
    reads.select(fasta(F.col("id"), F.col("description"), F.col("seq"))).write.mode("overwrite").text(o.output)
    if o.read_len > 0:
        reads.select(fasta(F.col("id"), F.col("description"), F.col("mate"))).write.mode("overwrite").text(o.output + ".mates")


def _otu_io(spark, o, change):
    from reedbank.sources.tables import read_otu_table, write_otu_table

    table = read_otu_table(spark, o.input)
    taxonomy = table.select("otu", "taxonomy").distinct()
    write_otu_table(change(table.select("otu", "sample", F.col("n"))).join(taxonomy, "otu"), o.output)


def _subset(spark, o):
    from reedbank.operators import otu

    _otu_io(spark, o, lambda t: otu.rarefy(t.where("n > 0").withColumn("n", F.col("n").cast("long")), o.size, o.method, o.seed))


def _norm(spark, o):
    from reedbank.operators import otu

    _otu_io(spark, o, lambda t: otu.normalise(t, o.Z, o.method))


def _merge(spark, o):
    from reedbank.operators import otu
    from reedbank.sources.tables import read_otu_table, write_otu_table

    if o.tree and not o.db:
        raise SystemExit("a tree needs --db")
    merged = otu.merge(*[read_otu_table(spark, t) for t in o.tables], taxonomy="taxonomy")
    write_otu_table(merged, o.output)
    if o.tree:
        from reedbank.plans import summarise
        from reedbank.sources.database import load
        from reedbank.sources.newick import build, write
        from reedbank.sources.text_models import write_text

        db = load(spark, o.db)
        cut = summarise.otu_tree(merged, db.node).join(db.node.select("id", "name"), "id")
        write_text(spark, write(build([(r.id, r.parent, r.name, r.length) for r in cut.toLocalIterator()])), o.tree)


def _jplace(spark, o):
    from reedbank.plans.summarise import filtered
    from reedbank.sources.database import load
    from reedbank.sources.jplace import document, placements, tree_text
    from reedbank.sources.tables import read_assignments

    db = load(spark, o.db)
    edges = db.node.where("parent is not null").select(F.col("id").alias("u"), F.col("parent").alias("v"), "length")
    rows = placements(filtered(read_assignments(spark, o.files), o.q, o.aln_iden, o.hmm_iden, db.profile.columns[1:]), edges)
    text = tree_text([(r.id, r.parent, r.name, r.length) for r in db.node.toLocalIterator()])
    more = {"invocation": " ".join(["jplace", o.db, *o.files])}
    if o.show_model:
        more["substitution_model"] = db.model.kind
    if o.show_var:
        more["among_site_rate_variation"] = "Discrete Gamma model" if db.rates is not None else "none"
    if o.show_anno:
        more["node_taxonomy_annotations"] = {str(r.id): r.anno for r in db.node.select("id", "anno").toLocalIterator()}
    with open(o.output, "w", encoding="utf-8") as f:
        for line in document(text, rows, more):
            f.write(line + "\n")


def _train_dm(spark, o):
    from reedbank.plans.build import profile_counts, train_prior
    from reedbank.sources.text_models import save_prior

    counts = profile_counts(read_alignment(spark, o.msa).select("id", "aln"), o.symfrac)
    save_prior(spark, train_prior(spark, counts, o.qM, o.n, o.pri_rate), o.output)


def _train_hmm(spark, o):
    from reedbank.kernels import hmm
    from reedbank.plans.build import profile_counts
    from reedbank.sources.text_models import save_profile

    save_profile(spark, hmm.build(profile_counts(read_alignment(spark, o.msa).select("id", "aln"), o.symfrac), _prior(spark, o.dm)), o.output)


def _train_sm(spark, o):
    from reedbank.plans.build import train_substitution
    from reedbank.sources.newick import flatten, parse
    from reedbank.sources.text_models import read_text, save_model

    rows = flatten(parse(read_text(spark, o.tree)))
    aligned = {r.name: r.aln for r in read_alignment(spark, o.msa).toLocalIterator()}
    nodes = spark.createDataFrame([(r[0], r[1]) for r in rows], "id LONG, parent LONG")
    sequences = spark.createDataFrame([(r[0], aligned[r[2]]) for r in rows if r[4]], "id LONG, aln STRING")
    save_model(spark, train_substitution(o.sub_model, nodes, sequences, method=o.method), o.output)


if __name__ == "__main__":
    sys.exit(main())
