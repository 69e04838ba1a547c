"""Simulated reads from a database: a branch by weight, a point on it, a stretch of columns, gaps and bases from what the tree says there."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from reedbank.kernels.likelihood import convolve, messages, node_heights, state_weights

READ = "id string, description string, seq string, mate string, branch_id string, taxon_id bigint"


def simulate(spark: SparkSession, db, n: int, mean: float = 500, sd: float = 30, least: int = 1, most: int | None = None, read_length: int = -1, max_height: float = float("inf"), keep_gaps: bool = False, regions: list[tuple[int, int]] | None = None, prefix: str = "r", seed: int = 0) -> DataFrame:
    """n reads; read i depends on (seed, i) alone, so the number of partitions doesn't matter.  regions: half-open 0-based stretches of columns.  With a
    read length, seq is the fragment's start and mate the start of its reverse complement; else mate is null."""
    tree, rows = db.tree()
    up, down = messages(tree, db.model, db.rates)
    usable = [u for u in range(len(rows)) if tree.parent[u] >= 0]
    gap_share = np.mean([[c not in "ACGTacgt" for c in r.aln] for r in db.msa.select("aln").toLocalIterator()], axis=0)
    shared = spark.sparkContext.broadcast((tree, db.model, up, down, usable, gap_share, [r.anno for r in rows], node_heights(tree)))
    width = len(gap_share)
    largest = most or width

    def run(batches):
        import pyarrow as pa

        tree, model, up, down, usable, gap_share, annos, heights = shared.value
        letters = np.array(list("ACGT"))
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                rng = np.random.default_rng([seed, i])
                while True:
                    u = usable[rng.integers(len(usable))]
                    v, ratio = int(tree.parent[u]), float(rng.random())
                    if heights[u] + tree.length[u] * ratio > max_height:
                        continue
                    size = int(np.clip(round(rng.normal(mean, sd)), least, largest))
                    low, high = regions[rng.integers(len(regions))] if regions else (0, width)
                    size = min(size, high - low)
                    start = int(rng.integers(low, high - size + 1))
                    break
                s = slice(start, start + size)
                w = tree.length[u]
                p = state_weights(convolve([up[u][:, s], down[u][:, s]], [w * ratio, w * (1 - ratio)], model))
                pick = (p.cumsum(0) < rng.random(size)[None, :]).sum(0).clip(0, 3)
                gaps = rng.random(size) < gap_share[s]
                text = "".join(np.where(gaps, "-", letters[pick]))
                plain = text if keep_gaps else text.replace("-", "")
                mate = None
                if read_length > 0:
                    back = plain[::-1].translate(str.maketrans("ACGT", "TGCA"))
                    plain, mate = plain[:read_length], back[:read_length]
                node = u if ratio <= 0.5 else v
                note = f'branchID={u}->{v};taxonID={node};taxonName="{annos[node]}";branchPoint={ratio:.6f};csStart={start + 1};csEnd={start + size};seqLen={len(plain)};'
                out.append((f"{prefix}{i}", note, plain, mate, f"{u}->{v}", node))
            kinds = [pa.string()] * 5 + [pa.int64()]
            names = [x.split()[0] for x in READ.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    return spark.range(n).mapInArrow(run, READ)
