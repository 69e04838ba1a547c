"""Assign reads: align each distinct sequence to the profile, place it on the tree, keep its best placement.

Reads are grouped by sequence first, so equal reads are aligned once.  Models are broadcast; a read's candidates are made, filtered and weighed in
one Arrow batch, so nothing is shuffled between alignment and the assignment."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbank.functions.sequence import reverse_complement
from reedbank.kernels import hmm
from reedbank.kernels.likelihood import Placer, Tree, posteriors
from reedbank.session import cut, meet
from reedbank.sources.database import Database

ALIGNED = "seq_start int, seq_end int, hmm_start int, hmm_end int, CS_start int, CS_end int, cost double, alignment string"
PLACED = "branch_id string, branch_ratio double, taxon_id bigint, taxon_anno string, anno_dist double, loglik double, Q_placement double, Q_taxon double"
CHIMERA = "seg5_taxon_id bigint, seg3_taxon_id bigint, chimera_lod double, is_chimera boolean"


@dataclass(frozen=True)
class Options:
    """Names and defaults of the assignment."""

    seeds: int = 50
    max_diff: float = float("inf")
    max_height: float = float("inf")
    max_error: float = 20.0
    method: str = "unweighted"
    prior: str = "uniform"
    ml: bool = False
    chimera: bool = False
    segments: int = 2
    chimera_error: float | None = None
    chimera_lod: float = 0.0
    single: bool = False
    align_only: bool = False
    seed_length: int = 20
    seed_region: int = 50
    batch: int = 16


def _codes(text: str) -> np.ndarray:
    from reedbank.functions.alphabet import NUCLEOTIDE

    return np.maximum(NUCLEOTIDE.table()[np.frombuffer(text.encode("ascii", "replace"), np.uint8).clip(0, 127)], 0)


#: k-mers of an index that are broadcast at most; reads meet a larger one by a join, with the same seeds.
MOST_KMERS = 2_000_000


class KmerTable:
    """First places of k-mers, as sorted arrays."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.k = len(rows[0][0]) if rows else 0
        word = np.array([r[0] for r in rows], f"S{max(1, self.k)}")
        order = np.argsort(word)
        self.word, self.place = word[order], np.array([r[1:] for r in rows], np.int32).reshape(-1, 2)[order]

    def find(self, words: list[str]) -> list[tuple[int, int] | None]:
        if not len(self.word) or not words:
            return [None] * len(words)
        asked = np.array([w.encode("ascii", "replace") for w in words], self.word.dtype)
        at = np.minimum(np.searchsorted(self.word, asked), len(self.word) - 1)
        return [tuple(map(int, self.place[i])) if hit else None for i, hit in zip(at, self.word[at] == asked, strict=True)]


class Seeds:
    """First and last k-mers of reads that an index has, as places on the profile.  A hit is (offset from 0, first column, last column)."""

    def __init__(self, profile: hmm.Profile, k: int, region: int, table: KmerTable | None = None):
        self.table, self.k, self.region = table, k, region
        # the profile position at, or just before, each column
        self.position = np.searchsorted(profile.columns, np.arange(profile.width + 2), side="right") - 1

    def hits(self, text: str) -> tuple[tuple | None, tuple | None]:
        """The first hit that starts in the first region bases, and the last one that starts in the last."""
        last = len(text) - self.k
        if last < 0:
            return None, None
        front, back = range(0, min(self.region, last + 1)), range(last, max(-1, last - self.region), -1)
        found = self.table.find([text[i : i + self.k] for i in (*front, *back)])
        one = lambda places, got: next(((i, *x) for i, x in zip(places, got, strict=True) if x), None)
        return one(front, found[: len(front)]), one(back, found[len(front) :])

    def of(self, text: str, both_ends: bool, hits: tuple | None = None) -> list[tuple[int, int, int, int]]:
        on_profile = lambda h: (h[0] + 1, h[0] + self.k, max(1, int(self.position[h[1]])), max(1, int(self.position[h[2]])))
        first, last = self.hits(text) if hits is None else hits
        out = [on_profile(first)] if first else []
        if both_ends and last and (not first or len(text) >= 2 * self.region):
            end = on_profile(last)
            if not out or (end[0] > out[0][1] and end[2] > out[0][3]):
                out.append(end)
        return out


def joined_hits(texts: DataFrame, kmers: DataFrame, k: int, region: int) -> DataFrame:
    """(text, first, last): the hits of Seeds for each of the distinct texts (a column text), by a join of their outer k-mers with the index."""
    from reedbank.operators.kmer import first

    last = F.length("text") - k
    places = F.array_distinct(F.concat(F.sequence(F.lit(0), F.least(F.lit(region - 1), last)), F.sequence(F.greatest(F.lit(0), last - (region - 1)), last)))
    windows = texts.where(F.length("text") >= k).select("text", F.explode(places).alias("at")).withColumn("kmer", F.substring("text", F.col("at") + 1, F.lit(k)))
    hits = meet(windows, first(kmers).select("kmer", "start", "end"), "kmer").select("text", F.struct("at", "start", "end").alias("h"))
    front, back = F.col("h.at") < region, F.col("h.at") > F.length("text") - k - region
    return hits.groupBy("text").agg(F.min(F.when(front, F.col("h"))).alias("first"), F.max(F.when(back, F.col("h"))).alias("last"))


def align_texts(aligner: hmm.Aligner, texts: list[str], batch: int, seeds: Seeds | None = None, hits: list | None = None) -> list[hmm.Alignment | None]:
    """Alignments of reads, in batches of equal length; with seeds, in bands around them, and without bands where that finds nothing.  hits: the
    texts' hits, where they are known already."""
    out: list[hmm.Alignment | None] = [None] * len(texts)
    n_profile = aligner.p.size
    found = {i: seeds.of(t, aligner.p.mode == "GLOBAL", hits[i] if hits else None) for i, t in enumerate(texts) if t} if seeds else {}

    def run(members: list[int], banded: bool) -> None:
        low = high = None
        n = len(texts[members[0]])
        if banded:
            bands = [hmm.band(found[i], n, n_profile) for i in members]
            low, high = np.min([x[0] for x in bands], axis=0), np.max([x[1] for x in bands], axis=0)
        for i, got in zip(members, aligner.align(np.stack([_codes(texts[i]) for i in members]), low, high), strict=True):
            out[i] = aligner.to_alignment(texts[i], got)

    # reads of one length that start at near places share a narrow band
    for banded in (True, False):
        rest = [i for i, t in enumerate(texts) if t and out[i] is None and (bool(found.get(i)) or not banded)]
        rest.sort(key=lambda i: (len(texts[i]), found[i][0][2] if banded else 0, i))
        at = 0
        while at < len(rest):
            end = at
            while end < len(rest) and end - at < batch and len(texts[rest[end]]) == len(texts[rest[at]]) and (not banded or found[rest[end]][0][2] - found[rest[at]][0][2] <= 50):
                end += 1
            run(rest[at:end], banded)
            at = end
    return out


class Assigner:
    """columns: the stretch [from, to) of the alignment that reads are placed on, where it is known; messages are made for it alone."""

    def __init__(self, profile: hmm.Profile, tree, model, rates, annos, anno_dists, heights, sequences, kmers, options: Options, columns: tuple[int, int] | None = None):
        self.o = options
        profile.mode = "NGCL" if options.single else "GLOBAL"
        self.aligner = hmm.Aligner(profile)
        table, k = kmers
        self.seeds = Seeds(profile, k, options.seed_region, table) if k else None
        self.annos, self.dists = annos, anno_dists
        self.offset, placed = 0, not options.align_only and tree is not None
        if placed and columns:
            self.offset = columns[0]
            tree, sequences = Tree(tree.parent, tree.length, tree.codes[:, slice(*columns)]), sequences[:, slice(*columns)]
        self.placer = Placer(tree, model, rates, heights, sequences) if placed else None

    def align(self, texts: list[str], hits: list | None = None) -> list[hmm.Alignment | None]:
        return align_texts(self.aligner, texts, self.o.batch, self.seeds, hits)

    def place_all(self, found: list[hmm.Alignment | None]) -> list[dict]:
        """Placements of alignments, whose seeds are looked for together."""
        reads = [(self._codes(a), *self._stretch(a)) for a in found if a is not None]
        seeds = iter(self.placer.seeds_of(reads, self.o.seeds, self.o.max_diff, self.o.max_height))
        return [self.place(a, next(seeds)) if a is not None else {} for a in found]

    def _codes(self, a: hmm.Alignment) -> np.ndarray:
        width = self.placer.sequences.shape[1]
        return np.array(["ACGT".find(c) for c in a.alignment[self.offset : self.offset + width].upper()], np.int8)

    def _stretch(self, a: hmm.Alignment) -> tuple[int, int]:
        return a.cs_start - 1 - self.offset, a.cs_end - self.offset

    def place(self, a: hmm.Alignment, seeds: list | None = None) -> dict:
        o, codes = self.o, self._codes(a)
        start, end = self._stretch(a)
        out = {}
        if o.chimera:
            error = o.chimera_error if o.chimera_error is not None else o.max_error / o.segments
            found = self.placer.chimera(codes, start, end, o.segments, o.seeds, error * o.segments, o.method)
            if found:
                lod, five, three = found
                out |= {"seg5_taxon_id": five, "seg3_taxon_id": three, "chimera_lod": float(lod), "is_chimera": bool(five != three and lod > o.chimera_lod)}
        placed = self.placer.place(codes, start, end, o.seeds, o.max_error, o.max_diff, o.max_height, o.method, seeds)
        if not placed:
            return out
        prior = [-(p.anno_dist + self.dists[p.node]) if o.prior == "height" else 0.0 for p in placed]
        x = [p.loglik + q for p, q in zip(placed, prior, strict=True)]
        q_place, q_taxon = posteriors(x, [self.annos[p.node] for p in placed])
        best = max(range(len(placed)), key=lambda i: ((placed[i].loglik if o.ml else x[i]), -placed[i].child))
        p = placed[best]
        return out | {
            "branch_id": f"{p.child}->{p.parent}", "branch_ratio": p.ratio, "taxon_id": p.node, "taxon_anno": self.annos[p.node],
            "anno_dist": p.anno_dist, "loglik": p.loglik, "Q_placement": float(q_place[best]), "Q_taxon": float(q_taxon[best]),
        }


#: A worker process makes an assigner once and keeps the last one, as its messages cost a pass over the tree.
_kept: dict[str, Assigner] = {}


def assigner_of(token: str, model: tuple) -> Assigner:
    if token not in _kept:
        _kept.clear()
        _kept[token] = Assigner(*model)
    return _kept[token]


def index_of(db: Database, options: Options, always: bool = False) -> tuple[KmerTable | None, int]:
    """(table, k): the k-mers' first places to be broadcast, or no table if there are too many; k is 0 without an index."""
    from reedbank.operators.kmer import first

    some = db.kmer.select("kmer").first()
    if some is None:
        return None, 0
    places = first(db.kmer).select("kmer", "start", "end")
    if not always and places.count() > MOST_KMERS:
        return None, len(some.kmer)
    return KmerTable([tuple(r) for r in places.toLocalIterator()]), len(some.kmer)


def model_of(db: Database, options: Options, always: bool = True) -> tuple:
    """What an Assigner is made from, to be broadcast: tree, models, and the k-mers' first places (without always, only if there are not too many)."""
    tree, rows = db.tree()
    return (db.profile, tree, db.model, db.rates, [r.anno for r in rows], [r.anno_dist for r in rows], np.array([r.height for r in rows]), tree.codes, index_of(db, options, always), options)


def _fields(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


_ARROW = {"string": "string", "int": "int32", "bigint": "int64", "double": "float64", "boolean": "bool_"}


def _batch(rows: list[dict], schema: str):
    import pyarrow as pa

    kinds = {x.split()[0]: x.split()[1] for x in schema.split(", ")}
    return pa.RecordBatch.from_arrays([pa.array([r.get(k) for r in rows], getattr(pa, _ARROW[t])()) for k, t in kinds.items()], names=list(kinds))


def align_sequences(sequences: DataFrame, db: Database, options: Options = Options()) -> DataFrame:
    """(seq, mate, alignment columns, in_order) for each row of sequences (seq, and mate, which may be null)."""
    spark = sequences.sparkSession
    table, k = index_of(db, options)
    shared, token = spark.sparkContext.broadcast((db.profile, None, None, None, None, None, None, None, (table, k), options)), uuid.uuid4().hex
    schema = ", ".join(["seq string, mate string", ALIGNED, "in_order boolean"])
    by_join = k and table is None
    source = sequences.select("seq", "mate")
    if by_join:
        texts = source.select(F.col("seq").alias("text")).union(source.select("mate")).where("text is not null").distinct()
        hits = joined_hits(texts, db.kmer, k, options.seed_region)
        for c in ("seq", "mate"):
            source = source.join(hits.select(F.col("text").alias(c), F.col("first").alias(f"{c}_first"), F.col("last").alias(f"{c}_last")), c, "left")
        source = source.select("seq", "mate", "seq_first", "seq_last", "mate_first", "mate_last")

    def run(batches):
        assigner = assigner_of(token, shared.value)
        names = _fields(ALIGNED)
        for batch in batches:
            seqs, mates = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            of = lambda i: [tuple(tuple(h.values()) if h else None for h in pair) for pair in zip(batch.column(i).to_pylist(), batch.column(i + 1).to_pylist(), strict=True)]  # noqa: E731, B023
            found, other = (assigner.align(t, of(i) if by_join else None) for t, i in ((seqs, 2), (mates, 4)))
            out = []
            for s, m, a, b in zip(seqs, mates, found, other, strict=True):
                row = {"seq": s, "mate": m, "in_order": True}
                if a is not None and b is not None:
                    row["in_order"] = a.cs_start <= b.cs_start and a.cs_end <= b.cs_end
                    a = hmm.merge_mates(a, b)
                if a is not None:
                    row |= dict(zip(names, (a.seq_start, a.seq_end, a.hmm_start, a.hmm_end, a.cs_start, a.cs_end, a.cost, a.alignment), strict=True))
                out.append(row)
            yield _batch(out, schema)

    return source.mapInArrow(run, schema)


def place_alignments(aligned: DataFrame, db: Database, options: Options = Options()) -> DataFrame:
    """Adds the chimera test and the best placement to rows of align_sequences; null where there is none.

    Messages are made for the columns that the alignments cover and no others, so that a worker's memory follows the region that was sequenced."""
    spark = aligned.sparkSession
    covered = aligned.agg(F.min("CS_start").alias("a"), F.max("CS_end").alias("z")).first()
    columns = (covered.a - 1, covered.z) if covered.a is not None else (0, 1)
    tree, rows = db.tree()
    model = (db.profile, tree, db.model, db.rates, [r.anno for r in rows], [r.anno_dist for r in rows], np.array([r.height for r in rows]), tree.codes, (None, 0), options, columns)
    shared, token = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    schema = ", ".join(["seq string, mate string", ALIGNED, *([CHIMERA] if options.chimera else []), PLACED])
    names = _fields(ALIGNED)

    def run(batches):
        assigner = assigner_of(token, shared.value)
        for batch in batches:
            told = batch.to_pylist()
            found = [hmm.Alignment(*[r[n] for n in names]) if r["alignment"] is not None else None for r in told]
            # mates that don't stand in order can't come from one fragment
            yield _batch([{k: r[k] for k in ("seq", "mate", *names)} | p | ({} if r["in_order"] else {"is_chimera": True}) for r, p in zip(told, assigner.place_all(found), strict=True)], schema)

    return aligned.mapInArrow(run, schema)


def assign_sequences(sequences: DataFrame, db: Database, options: Options = Options()) -> DataFrame:
    """One row for each row of sequences (seq, and mate, which may be null): alignment, chimera test and best placement; null where there is none."""
    aligned = align_sequences(sequences, db, options)
    if options.align_only:
        schema = _fields(", ".join(["seq string, mate string", ALIGNED, *([CHIMERA] if options.chimera else [])]))
        more = {c: F.lit(None).cast(t) for c, t in (x.split() for x in CHIMERA.split(", "))} if options.chimera else {}
        return aligned.withColumns(more).withColumn("is_chimera", F.when(~F.col("in_order"), F.lit(True))).select(*schema) if options.chimera else aligned.select(*schema)
    return place_alignments(cut(aligned), db, options)


def detect_strand(reads: DataFrame, db: Database, test: int = 100, share: float = 0.9) -> int:
    """1 or 2 by how test reads align as they are and as reverse complement; 0 without a clear vote.  The number of reads is a bound of the feature."""
    from reedbank.operators.assignment import strand_vote

    some = reads.select("id", "seq").orderBy("id").limit(test)
    options = Options(single=True, align_only=True)
    both = some.select("id", F.col("seq").alias("seq"), F.lit(None).cast("string").alias("mate"), F.lit("f").alias("way")).unionByName(
        some.select("id", reverse_complement(F.col("seq")).alias("seq"), F.lit(None).cast("string").alias("mate"), F.lit("r").alias("way"))
    )
    costs = assign_sequences(both.select("seq", "mate").distinct(), db, options).select("seq", "cost")
    joined = both.join(costs, "seq", "left").groupBy("id").agg(F.min(F.when(F.col("way") == "f", F.col("cost"))).alias("cost_fwd"), F.min(F.when(F.col("way") == "r", F.col("cost"))).alias("cost_rev"))
    far = F.lit(1e9)
    return strand_vote(joined.select(F.coalesce("cost_fwd", far).alias("cost_fwd"), F.coalesce("cost_rev", far).alias("cost_rev")), share=share).first().strand


def assign(reads: DataFrame, db: Database, mates: DataFrame | None = None, options: Options = Options(), strand: int = 1) -> DataFrame:
    """Assignments of reads (id, description, seq), with mates by column ordinal of both; strand 2 turns reads round, and swaps mates."""
    if mates is not None:
        pairs = reads.join(mates.select("ordinal", F.col("seq").alias("__mate")), "ordinal")
        first, second = F.col("seq"), reverse_complement(F.col("__mate"))
        if strand == 2:
            first, second = F.col("__mate"), reverse_complement(F.col("seq"))
        own = pairs.select("id", "description", first.alias("seq"), second.alias("mate"))
    else:
        own = reads.select("id", "description", (reverse_complement(F.col("seq")) if strand == 2 else F.col("seq")).alias("seq"), F.lit(None).cast("string").alias("mate"))
    found = assign_sequences(own.select("seq", "mate").distinct(), db, options)
    key = (own["seq"].eqNullSafe(found["seq"])) & (own["mate"].eqNullSafe(found["mate"]))
    return own.join(found, key, "left").select(own["id"], own["description"], *[found[c] for c in found.columns if c not in ("seq", "mate")])
