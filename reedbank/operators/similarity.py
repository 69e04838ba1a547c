"""Similarity joins of reads with tree nodes: nearest nodes by p-distance, and primer efficiency."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reedbank.functions.alphabet import DNA
from reedbank.kernels.segments import Index
from reedbank.operators.placement import top_candidates
from reedbank.session import spread, stored

#: Reads and nodes of a block, and bytes of the node blocks that one task goes through.
READS_A_BLOCK, NODES_A_BLOCK, BLOCK_BYTES = 512, 1 << 14, 64 << 20
#: From so many nodes a part on, and up to so many columns, nodes are searched by their segments' letters; reads of a block that are then searched in one task.
LEAST_INDEXED, MOST_INDEXED_COLUMNS, READS_A_SEARCH = 1 << 19, 64, 1 << 12
#: By how much shares of equal bases may be off in single precision; what is nearer than that to the last of the best is counted exactly.
SLACK = 1e-5


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Codes of aligned texts, -1 for anything that isn't a base; short texts are filled up."""
    table = DNA.table()
    raw = np.frombuffer("".join((t or "")[:width].ljust(width, "-") for t in texts).encode("ascii", "replace"), np.uint8)
    return np.maximum(table[np.minimum(raw, 127)], -1).reshape(len(texts), width)


def blocks(rows: DataFrame, width: int, rows_each: int, name: str) -> DataFrame:
    """(<name>_ids, <name>_codes) of blocks of rows (id, seq): 64-bit ids and codes of width bytes, rows_each to a block."""

    def run(batches):
        import pyarrow as pa

        ids, texts = [], []
        made = lambda i, t: pa.RecordBatch.from_arrays([pa.array([np.array(i, np.int64).tobytes()], pa.binary()), pa.array([_codes(t, width).tobytes()], pa.binary())], names=[f"{name}_ids", f"{name}_codes"])
        for batch in batches:
            ids, texts = ids + batch.column(0).to_pylist(), texts + batch.column(1).to_pylist()
            while len(ids) >= rows_each:
                yield made(ids[:rows_each], texts[:rows_each])
                ids, texts = ids[rows_each:], texts[rows_each:]
        if ids:
            yield made(ids, texts)

    return stored(spread(rows, rows_each).mapInArrow(run, f"{name}_ids binary, {name}_codes binary"), f"blocks_of_{name}s")


class Nearest:
    """The n nearest nodes of a block of reads among blocks of nodes that come one after the other, equal ones by node."""

    def __init__(self, codes: np.ndarray, n: int):
        self.codes, self.n = codes, n
        self.row, self.dist, self.node = np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64)
        self.least = np.full(len(codes), -np.inf, np.float32)
        self.hot = self._hot(codes)
        self.full = bool((codes >= 0).all())

    @staticmethod
    def _hot(codes: np.ndarray) -> np.ndarray:
        return np.concatenate([codes == b for b in range(4)], axis=1).astype(np.float32)

    def add(self, ids: np.ndarray, codes: np.ndarray) -> None:
        some = (codes >= 0).any(axis=1)
        ids, codes = ids[some], codes[some]
        if not len(ids) or not self.n:
            return
        hot, has = self._hot(codes), (codes >= 0).astype(np.float32)
        if self.full:
            share = self.hot @ (hot / has.sum(axis=1, keepdims=True)).T
        else:
            both = (self.codes >= 0).astype(np.float32) @ has.T
            share = np.where(both > 0, (self.hot @ hot.T) / np.maximum(both, 1), -np.inf).astype(np.float32)
        if len(ids) > self.n and np.isinf(self.least).any():
            self.least = np.maximum(self.least, np.partition(share, -self.n, axis=1)[:, -self.n] - np.float32(SLACK))
        row, at = np.nonzero((share >= self.least[:, None]) & (share > -np.inf))
        if not len(row):
            return
        reads, nodes = self.codes[row], codes[at]
        both = ((reads >= 0) & (nodes >= 0)).sum(axis=1)
        dist = (both - ((reads == nodes) & (reads >= 0)).sum(axis=1)) / both
        row, dist, node = np.r_[self.row, row], np.r_[self.dist, dist], np.r_[self.node, ids[at]]
        order = np.lexsort((node, dist, row))
        row, dist, node = row[order], dist[order], node[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < self.n
        self.row, self.dist, self.node = row[keep], dist[keep], node[keep]
        last = place[keep] == self.n - 1
        self.least[self.row[last]] = (1 - self.dist[last] - SLACK).astype(np.float32)


def nearest_nodes(reads: DataFrame, nodes: DataFrame, n: int, width: int, read: str = "read", read_seq: str = "seq", node: str = "id", node_seq: str = "seq", max_height: float | None = None) -> DataFrame:
    """(read, node, dist): the n nearest nodes of each read, equal ones by node, unknown distances left out.

    Reads and nodes are packed into blocks in tasks, and every block of reads meets every block of nodes in a product of the two tables; a read's pairs never leave the
    task, only its n best among the nodes of a part do.  Where parts are large and rows short, an index of the part leaves out most nodes that can't be among the
    best.  Otherwise shares of equal bases come from a matrix product; what may be among the best is counted exactly."""
    if max_height is not None:
        nodes = nodes.where(F.col("height") <= max_height)
    each = max(1, min(NODES_A_BLOCK, BLOCK_BYTES // (8 + width)))
    right = blocks(nodes.select(F.col(node).cast("long"), F.col(node_seq)), width, each, "node")
    n_blocks = right.count()
    parts = max(1, n_blocks * min(NODES_A_BLOCK * (8 + width), BLOCK_BYTES) // BLOCK_BYTES)
    indexed = n_blocks * each // parts >= LEAST_INDEXED and width <= MOST_INDEXED_COLUMNS
    left = blocks(reads.select(F.col(read).cast("long"), F.col(read_seq)), width, READS_A_SEARCH if indexed else READS_A_BLOCK, "read")
    # by ranges, which deal out few rows evenly
    pairs = left.repartitionByRange(max(1, left.count()), F.xxhash64("read_ids")).crossJoin(right.repartition(parts).hint("shuffle_replicate_nl"))
    of = lambda x, kind: np.frombuffer(x.as_py(), kind)

    def made(rid, row, node, dist):
        import pyarrow as pa

        return pa.RecordBatch.from_arrays([pa.array(np.frombuffer(rid, np.int64)[row]), pa.array(node), pa.array(dist)], names=["read", "node", "dist"])

    def search(batches):
        found, first, ids, codes = {}, None, [], []
        for batch in batches:
            for rid, rcode, nid, ncode in zip(*batch.columns, strict=True):
                key = rid.as_py()
                first = key if first is None else first
                if key not in found:
                    found[key] = of(rcode, np.int8).reshape(-1, width)
                # every block of reads comes with the same blocks of nodes
                if key == first:
                    ids.append(of(nid, np.int64))
                    codes.append(of(ncode, np.int8).reshape(-1, width))
        if not found:
            return
        index = Index(np.concatenate(ids), np.concatenate(codes))
        del ids, codes
        for key, own in found.items():
            best = list(index.nearest(own, n))
            yield made(key, np.repeat([i for i, _, _ in best], [len(x) for _, x, _ in best]), np.concatenate([x for _, x, _ in best]), np.concatenate([x for _, _, x in best]))

    def run(batches):
        best = {}
        for batch in batches:
            for rid, rcode, nid, ncode in zip(*batch.columns, strict=True):
                key = rid.as_py()
                if key not in best:
                    best[key] = Nearest(of(rcode, np.int8).reshape(-1, width), n)
                best[key].add(of(nid, np.int64), of(ncode, np.int8).reshape(-1, width))
        for key, x in best.items():
            yield made(key, x.row, x.node, x.dist)

    out = pairs.mapInArrow(search if indexed else run, "read bigint, node bigint, dist double")
    return out if parts == 1 else top_candidates(out, n).drop("rank")


#: Primers that one pass over the nodes takes.
MOST_PRIMERS = 1000


def primer_hits(primers: DataFrame, nodes: DataFrame, identity: float = 0.9) -> DataFrame:
    """(primer, total_nodes, total_leaves, hit_nodes, hit_leaves, efficiency_nodes, efficiency_leaves).

    primers: (primer, seq, start): seq stands on columns start.. of the nodes' alignment (1-based), with degenerate letters.  Primers go to the nodes as an array in
    each row, MOST_PRIMERS at a time.  nodes: (id, aln, is_leaf).  A node is hit if at most 1 - identity of the columns can't match."""
    blocks = -(-primers.count() // MOST_PRIMERS) or 1
    out = None
    for block in range(blocks):
        part = primers.where(F.pmod(F.xxhash64("primer"), F.lit(blocks)) == block) if blocks > 1 else primers
        got = _primer_hits(part, nodes, identity)
        out = got if out is None else out.unionByName(got)
    return out


def _primer_hits(primers: DataFrame, nodes: DataFrame, identity: float) -> DataFrame:
    from reedbank.functions.sequence import degenerate_match

    listed = primers.agg(F.collect_list(F.struct("primer", "seq", "start")).alias("listed"))
    pairs = nodes.crossJoin(F.broadcast(listed)).select(*nodes.columns, F.inline("listed"))
    window = F.substring("aln", F.col("start"), F.length("seq"))
    differ = F.size(F.filter(F.arrays_zip(F.split(window, "").alias("a"), F.split(F.col("seq"), "").alias("b")), lambda x: ~degenerate_match(x["a"], x["b"])))
    hit = differ <= (1 - identity) * F.length("seq") + 1e-9
    sums = pairs.withColumn("hit", hit).groupBy("primer").agg(
        F.count("*").alias("total_nodes"), F.count_if("is_leaf").alias("total_leaves"), F.count_if("hit").alias("hit_nodes"), F.count_if(F.col("hit") & F.col("is_leaf")).alias("hit_leaves")
    )
    return sums.withColumn("efficiency_nodes", F.try_divide("hit_nodes", "total_nodes")).withColumn("efficiency_leaves", F.try_divide("hit_leaves", "total_leaves"))
