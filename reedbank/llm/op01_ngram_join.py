"""Operator 1: exact Jaccard self-join of word shingle sets, with a size-aware heavy-light scheme.

Equal sets are one node from the start (a 64-bit hash of the set), so copies cost nothing further.  Nodes that may link get a key in common:

* light sets (at most x shingles): all fixed-size subsets.  Two sets of sizes a and b that link share a subset of ceil(4(a+b)/9) shingles, so each enumerates
  the subsets of the sizes that its possible partners ask for; a hash of the subset is the key;
* heavy sets: inverted lists of shingles.  In any one order of all shingles, linked sets have a common one among the first n - ceil(0.8 n) + 1 of each, so only these
  are listed.  The order is rare shingles first: SAMPLED of all shingles (by hash) are counted over the whole input and come first, by their count and then by hash; after
  them come the ones that aren't counted, by hash, and last the most frequent ones.  Most texts have enough counted shingles of their own to fill
  their first ones, and these lists of one set are never made, so a passage that very many texts share makes no long lists;
* x is where the estimated number of subset keys and list entries is least, given the numbers of sets by size.

Counting: a unit of the input asks buckets of shingles for the counts of its sampled ones; the answers go back to the unit, whose sets travel with their
sampled shingles only.  Under a key with more than FEW sets in a unit, one of them goes on, linked with the others, so a list grows with the number of
units and not with that of its sets.

Keys are sorted in buckets.  Nodes under a key with at most FEW nodes are candidate pairs, those under longer lists are joined in spanning forests, never
as pairs.  A candidate pair stays if the parities of its sets' hashed shingles differ in no more places than the sets may (a lower bound of their
difference, so no link is lost).  Components of forests and pairs are blocks of candidates.  In each block sets are compared exactly: a pivot with all sets not yet in its component, by vectorised counting.  Large blocks are split; all parts
are compared with a few pivots, and only sets outside the block's main component go to all parts.

Rows: texts are lower-cased (A-Z) and cut at ASCII white space.  Texts with fewer than 5 words are one shingle; texts without words (or null) have
an empty set, which links with nothing.  Repeated rows link as copies.  A null key is kept; component_id is the smallest key that isn't null.  Other columns are
ignored.  Sets are compared by 64-bit hashes of shingles, which mix all bytes of their words.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reedbank.llm import textops as X
from reedbank.llm.components import components, contract, local_components
from reedbank.llm.shared import join_hot, parts_for, read_table, small_batches, written

WORDS = 5
#: Links: 100 * intersection >= NEED * union.
NEED = 80
LIGHT_MOST = 16
#: A shingle is frequent if it is at least one in this many of all shingles; at most twice as many are broadcast (8 bytes each).
FREQUENT = 1 << 18
CHUNK = 1 << 21
SUB_SETS, SUB_SHINGLES, PIVOTS, REST = 4096, 1 << 20, 4, 2048
#: Bytes of input for each bucket of keys; its keys and nodes take about three times as much memory.
BUCKET_BYTES = 16 << 20
#: The share of shingles that is counted, as a bound of their hashes.
SAMPLED_BELOW = np.uint64(int(0.3 * 2**64))
#: Places of the filter of keys; 1 MB.
FILTER_BITS = 1 << 23
#: Lists with at most this many nodes are taken apart into pairs.
FEW = 8
_C1, _C2, _C3 = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def overlap_needed(a: int, b: int) -> int:
    """Least intersection of linked sets of sizes a and b."""
    return -(-NEED * (a + b) // (100 + NEED))


def linked(inter, a, b):
    return 100 * inter >= NEED * (a + b - inter)


# ---- sets


def shingle_sets(words: X.Words) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of a block's rows, one row after the other, and the rows' bounds."""
    runs, first = X.run_hashes(words.hash, WORDS), words.first
    parts, sizes = [], np.zeros(len(first) - 1, np.int64)
    for r in range(len(sizes)):
        a, b = int(first[r]), int(first[r + 1])
        if b == a:
            continue
        got = np.unique(runs[a : b - WORDS + 1]) if b - a >= WORDS else X.run_hashes(words.hash[a:b], b - a)
        parts.append(got)
        sizes[r] = len(got)
    bounds = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=bounds[1:])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), bounds


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of the rows' values, with wrap-around for hashes."""
    sums = np.zeros(len(values) + 1, values.dtype)
    with np.errstate(over="ignore"):
        np.cumsum(values, out=sums[1:])
        return sums[bounds[1:]] - sums[bounds[:-1]]


def node_ids(sets: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return X.mix64(row_sums(X.mix64(sets + _C3), bounds) + np.diff(bounds).astype(np.uint64) * _C1)


def parity_sketches(sets: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """For each set, how many of its shingles fall on each of about as many places, modulo 2.  Two sets' sketches differ in no more places than the sets
    themselves; a sketch folds to half its places by adding its halves."""
    out = []
    for r in range(len(bounds) - 1):
        h = sets[bounds[r] : bounds[r + 1]]
        places = max(8, 1 << (len(h) - 1).bit_length()) if len(h) else 8
        out.append(np.packbits((np.bincount((h & np.uint64(places - 1)).astype(np.int64), minlength=places) & 1).astype(np.uint8)).tobytes())
    return out


def fold(x: np.ndarray, width: int) -> np.ndarray:
    while x.shape[1] > width:
        x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return x


def sketch_differences(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """In how many places the sketches of each pair differ, all pairs with the same two lengths at a time."""
    out = np.zeros(len(a), np.int64)
    sizes = np.array([len(x) for x in a]) * (1 << 32) + np.array([len(x) for x in b])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        width = min(int(size) >> 32, int(size) & ((1 << 32) - 1))
        x, y = (fold(np.frombuffer(b"".join(side[i] for i in at), np.uint8).reshape(len(at), -1), width) for side in (a, b))
        out[at] = np.bitwise_count(x ^ y).sum(axis=1)
    return out


# ---- keys


def first_of(n):
    """How many of a set's shingles, in an order of all, have one in common with those of each set that it links with."""
    return n + (-NEED * n // 100) + 1


def sampled(h: np.ndarray) -> np.ndarray:
    """Which shingles are counted."""
    with np.errstate(over="ignore"):
        return X.mix64(h + _C2) < SAMPLED_BELOW


def subset_sizes(n: int, light: int) -> list[int]:
    """Sizes of subsets that a light set of n shingles enumerates."""
    partners = range(max(1, -(-NEED * n // 100)), min(light, 100 * n // NEED) + 1)
    return sorted({c for b in partners if (c := overlap_needed(n, b)) <= min(n, b)})


def light_boundary(count_by_size: dict[int, int]) -> int:
    """x with the least estimated cost; a list entry counts twice, as it also meets sets that don't link."""

    def cost(x: int) -> float:
        total = 0.0
        for n, count in count_by_size.items():
            if n <= x:
                total += count * sum(math.comb(n, c) for c in subset_sizes(n, x))
            if 100 * n >= NEED * (x + 1):
                total += 2 * count * first_of(n)
        return total

    return min(range(LIGHT_MOST + 1), key=lambda x: (cost(x), x))


def subset_keys(h: np.ndarray, sizes: list[int]) -> np.ndarray:
    """Keys of all subsets of the given sizes, as the whole less what is left out."""
    v, out = X.mix64(h + _C1), []
    with np.errstate(over="ignore"):
        whole = v.sum(dtype=np.uint64)
        for c in sizes:
            left = len(h) - c
            gone = v[np.array(list(itertools.combinations(range(len(h)), left)), dtype=np.int64)].sum(axis=1, dtype=np.uint64) if left else np.zeros(1, np.uint64)
            out.append(X.mix64(whole - gone + np.uint64(c) * _C2))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def is_frequent(sets: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    out = np.zeros(len(sets), bool)
    if len(frequent):
        at = np.arange(len(sets))
        if len(sets) > len(frequent) // 4:
            bits = np.zeros(1 << 22, bool)
            bits[(frequent >> np.uint64(42)).astype(np.int64)] = True
            at = np.flatnonzero(bits[(sets >> np.uint64(42)).astype(np.int64)])
        place = np.minimum(np.searchsorted(frequent, sets[at]), len(frequent) - 1)
        out[at] = frequent[place] == sets[at]
    return out


def carried_of(sets: np.ndarray, bounds: np.ndarray, light: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, their rows, whether they are counted) that keys of the sets can come from, in the order of rows: a light set's all, a heavy one's sampled shingles
    and, where they are fewer than its first ones, so many of the others, those that aren't frequent first."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    often = is_frequent(sets, frequent)
    counted = sampled(sets) & ~often
    heavy = 100 * sizes >= NEED * (light + 1)
    have = np.bincount(row, weights=counted, minlength=len(sizes)).astype(np.int64)
    missing = np.where(heavy, np.maximum(first_of(sizes) - have, 0), 0)
    use = (counted & heavy[row]) | (sizes <= light)[row]
    for r in np.flatnonzero(missing):
        at = np.arange(bounds[r], bounds[r + 1])
        at = at[~counted[at]]
        with np.errstate(over="ignore"):
            order = np.lexsort((X.mix64(sets[at] + _C1), often[at]))
        use[at[order[: missing[r]]]] = True
    return sets[use], row[use], counted[use]


def keys_of(n: np.ndarray, shingles: np.ndarray, row: np.ndarray, counted: np.ndarray, times: np.ndarray, light: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, rows) of sets of n shingles from what carried_of gave for them; times: counts of the counted ones.  Keys that no other set can have are left out."""
    keys, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    bounds = np.searchsorted(row, np.arange(len(n) + 1))
    for r in np.flatnonzero((n <= light) & (n > 0)):
        got = subset_keys(np.sort(shingles[bounds[r] : bounds[r + 1]]), subset_sizes(int(n[r]), light))
        keys.append(got)
        rows.append(np.full(len(got), r))
    heavy = 100 * n >= NEED * (light + 1)
    with np.errstate(over="ignore"):
        order = np.lexsort((X.mix64(shingles + _C1), is_frequent(shingles, frequent), np.where(counted, times, np.iinfo(np.int64).max), row))
    rank = np.arange(len(row)) - bounds[row]
    own = order[(rank < first_of(n)[row]) & heavy[row]]
    own = own[~counted[own] | (times[own] > 1)]
    with np.errstate(over="ignore"):
        keys.append(X.mix64(shingles[own] * _C1 + _C2))
    rows.append(row[own])
    return np.concatenate(keys), np.concatenate(rows)


# ---- comparing


def compare(sets: list[np.ndarray], group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Components of the sets by exact links (smallest place in each), and each set's rank as a pivot; group: labels that are known to be joined."""
    n = len(sets)
    label = np.arange(n) if group is None else group.copy()
    sizes = np.array([len(s) for s in sets])
    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    start = np.r_[0, np.cumsum(sizes)]
    # sets with common shingles first: they are nearest to the middle of their group
    order = np.argsort(-np.add.reduceat(np.bincount(ids)[ids], start[:-1]) / sizes, kind="stable")
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    mark = np.zeros(len(flat), bool)
    for p in order:
        open_ = (rank > rank[p]) & (label != label[p]) & (100 * np.minimum(sizes, sizes[p]) >= NEED * np.maximum(sizes, sizes[p]))
        if not open_.any():
            continue
        mine = ids[start[p] : start[p + 1]]
        mark[mine] = True
        at = np.flatnonzero(open_)
        if len(at) * 16 < n:
            inter = np.array([np.count_nonzero(mark[ids[start[r] : start[r + 1]]]) for r in at])
        else:
            inter = np.add.reduceat(mark[ids], start[:-1], dtype=np.int64)[at]
        mark[mine] = False
        for other in np.unique(label[at[linked(inter, sizes[at], sizes[p])]]):
            label[label == other] = label[p]
    smallest = np.full(int(label.max(initial=0)) + 1, n)
    np.minimum.at(smallest, label, np.arange(n))
    return smallest[label], rank


def cross_links(left: list[np.ndarray], right: list[np.ndarray], left_label: np.ndarray, right_label: np.ndarray):
    """(i, j) for each left set: one right set of every label other than its own that it links with."""
    if not left or not right:
        return
    sizes = np.array([len(s) for s in right])
    flat, ids = np.unique(np.concatenate(right), return_inverse=True)
    start = np.r_[0, np.cumsum(sizes)]
    mark = np.zeros(len(flat) + 1, bool)
    for i, mine in enumerate(left):
        open_ = (right_label != left_label[i]) & (100 * np.minimum(sizes, len(mine)) >= NEED * np.maximum(sizes, len(mine)))
        if not open_.any():
            continue
        place = np.searchsorted(flat, mine)
        place = place[(place < len(flat)) & (flat[np.minimum(place, len(flat) - 1)] == mine)]
        mark[place] = True
        inter = np.add.reduceat(mark[ids], start[:-1], dtype=np.int64)
        mark[place] = False
        hit = np.flatnonzero(open_ & linked(inter, sizes, len(mine)))
        for j in hit[np.unique(right_label[hit], return_index=True)[1]] if len(hit) else ():
            yield i, int(j)


# ---- the join


def _sets_of_texts(column) -> list[np.ndarray]:
    data, offsets = X.column_bytes(column)
    out = []
    for row, end, block, own in X.blocks(data, offsets):
        sets, bounds = shingle_sets(X.Words(block, own, X.NON_SPACE))
        out += [sets[bounds[r] : bounds[r + 1]] for r in range(end - row)]
    return out


def _statistics(source: DataFrame, key_type: str) -> DataFrame:
    """(key, n, node, sketch) of each row, and rows with n = -1 that count shingles (node) in a chunk of the input (times)."""

    def run(batches):
        import pyarrow as pa

        waiting, held = [], 0

        def counted():
            values, times = np.unique(np.concatenate(waiting), return_counts=True)
            often = np.flatnonzero(times >= max(4, held // (2 * FREQUENT)))
            return values[often], times[often]

        def rows(keys, n, node, times, sketches=None):
            sketch = pa.array(sketches, pa.binary()) if sketches is not None else pa.nulls(len(n), pa.binary())
            return pa.RecordBatch.from_arrays([keys, pa.array(n, pa.int64()), pa.array(node.view(np.int64)), pa.array(times, pa.int64()), sketch], names=["key", "n", "node", "times", "sketch"])

        kind = None
        for batch in batches:
            kind = batch.column(0).type
            data, offsets = X.column_bytes(batch.column(1))
            for row, end, block, own in X.blocks(data, offsets):
                sets, bounds = shingle_sets(X.Words(block, own, X.NON_SPACE))
                yield rows(batch.column(0).slice(row, end - row), np.diff(bounds), node_ids(sets, bounds), np.zeros(end - row, np.int64), parity_sketches(sets, bounds))
                waiting.append(sets)
                held += len(sets)
                if held >= CHUNK:
                    values, times = counted()
                    yield rows(pa.nulls(len(values), kind), np.full(len(values), -1), values, times)
                    waiting, held = [], 0
        if held:
            values, times = counted()
            yield rows(pa.nulls(len(values), kind), np.full(len(values), -1), values, times)

    return source.mapInArrow(run, f"key {key_type}, n bigint, node bigint, times bigint, sketch binary")


UNITS = "bucket int, own bigint, unit bigint, shingles binary, a binary, b binary, c binary"


def _bytes_table(schema: str, rows: list[tuple]):
    import pyarrow as pa

    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.table({k: pa.array([r[i] for r in rows], kinds[t]) for i, (k, t) in enumerate(fields)})


def _in_buckets(values: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of values by bucket, and the bounds of the buckets in it."""
    bucket = (X.mix64(values) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


def _units(source: DataFrame, shared, light: int, buckets: int) -> DataFrame:
    """A unit's rows: its sampled shingles by bucket, with the number of its sets that have them (own is -1); and one of bucket -1 with its sets (own is the unit)."""

    def run(batches):
        from pyspark import TaskContext

        part, waiting, held, made = TaskContext.get().partitionId(), [], 0, 0

        def unit():
            nodes = np.concatenate([x[0] for x in waiting])
            # copies once
            use = np.zeros(len(nodes), bool)
            use[np.unique(nodes, return_index=True)[1]] = True
            n = np.concatenate([x[1] for x in waiting])
            first = np.cumsum([0, *[len(x[0]) for x in waiting]])
            shingles, counted = (np.concatenate([x[i] for x in waiting]) for i in (2, 4))
            row = np.concatenate([x[3] + at for x, at in zip(waiting, first, strict=False)])
            kept = use[row]
            shingles, counted, row = shingles[kept], counted[kept], (np.cumsum(use) - 1)[row[kept]]
            nodes, n = nodes[use], n[use]
            number = (part << 24) | made
            asked, times = np.unique(shingles[counted], return_counts=True)
            order, cut = _in_buckets(asked, buckets)
            asked, times = asked[order], times[order].astype(np.uint32)
            rows = [(int(b), -1, number, asked[cut[b] : cut[b + 1]].tobytes(), times[cut[b] : cut[b + 1]].tobytes(), b"", b"") for b in np.flatnonzero(np.diff(cut))]
            per_row = np.bincount(row, minlength=len(n)).astype(np.uint32)
            rows.append((-1, number, number, shingles.tobytes(), np.concatenate([nodes, n.astype(np.uint64)]).tobytes(), per_row.tobytes(), np.packbits(counted).tobytes()))
            return _bytes_table(UNITS, rows).to_batches()

        for batch in batches:
            data, offsets = X.column_bytes(batch.column(0))
            for _, _, block, own in X.blocks(data, offsets):
                sets, bounds = shingle_sets(X.Words(block, own, X.NON_SPACE))
                some = np.flatnonzero(np.diff(bounds))
                if not len(some):
                    continue
                waiting.append((node_ids(sets, bounds)[some], np.diff(bounds)[some], *carried_of(sets, np.r_[bounds[some], bounds[-1]], light, shared.value)))
                held += len(sets)
                if held >= CHUNK:
                    yield from unit()
                    waiting, held, made = [], 0, made + 1
        if waiting:
            yield from unit()

    return source.select("text").mapInArrow(run, UNITS)


def _counted(units: DataFrame) -> DataFrame:
    """To each unit the counts over all units of the shingles that it asked a bucket for, at most 255 each; and its own row."""

    def run(key, table):
        if key[0].as_py() < 0:
            return table
        asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
        every, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, weights=np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("a")]), minlength=len(every))
        times = np.minimum(total, 255).astype(np.uint8)[back]
        ends = np.cumsum([len(x) for x in asked])
        return _bytes_table(UNITS, [(key[0].as_py(), -1, u, b"", times[z - len(x) : z].tobytes(), b"", b"") for u, x, z in zip(table.column("unit").to_pylist(), asked, ends, strict=True)])

    return units.groupBy("bucket", "own").applyInArrow(run, UNITS)


LISTED = "bucket int, keys binary, nodes binary"


def _listed(answers: DataFrame, shared, light: int, buckets: int) -> DataFrame:
    """A unit's keys and nodes by bucket of keys; links inside the unit, as buckets below 0."""

    def run(table):
        at = {b: i for i, b in enumerate(table.column("bucket").to_pylist())}
        get = lambda c, b, t: np.frombuffer(table.column(c)[at[b]].as_buffer(), t)
        shingles, per_row = get("shingles", -1, np.uint64), get("b", -1, np.uint32)
        nodes, n = np.split(get("a", -1, np.uint64), 2)
        counted = np.unpackbits(get("c", -1, np.uint8))[: len(shingles)].astype(bool)
        # the counts come in the order that the unit asked for them
        asked, back = np.unique(shingles[counted], return_inverse=True)
        order = _in_buckets(asked, buckets)[0]
        of = np.zeros(len(asked), np.int64)
        of[order] = np.concatenate([np.zeros(0, np.uint8), *[get("a", b, np.uint8) for b in sorted(at) if b >= 0]])
        times = np.zeros(len(shingles), np.int64)
        times[counted] = of[back]
        key, row = keys_of(n.astype(np.int64), shingles, np.repeat(np.arange(len(n)), per_row), counted, times, light, shared.value)
        node = nodes[row]
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        new = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
        key, node = key[new], node[new]
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        sizes = np.diff(np.r_[start, len(key)])
        # of many sets under a key one goes on
        head = np.repeat(start, sizes)
        stays = (np.arange(len(key)) != head) & np.repeat(sizes > FEW, sizes)
        rows = []
        if stays.any():
            links = np.unique(np.column_stack([node[stays], node[head[stays]]]), axis=0)
            rows.append((int(-1 - table.column("unit")[0].as_py() % buckets), links[:, 0].tobytes(), links[:, 1].tobytes()))
        key, node = key[~stays], node[~stays]
        order, cut = _in_buckets(key, buckets)
        key, node = key[order], node[order]
        rows += [(int(b), key[cut[b] : cut[b + 1]].tobytes(), node[cut[b] : cut[b + 1]].tobytes()) for b in np.flatnonzero(np.diff(cut))]
        return _bytes_table(LISTED, rows)

    return answers.groupBy("unit").applyInArrow(run, LISTED)


def _forests(source: DataFrame, light: int, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(a, b, is_pair): edges of spanning forests of the nodes under long lists, a forest for each bucket of keys, and pairs of nodes under short lists."""
    shared = source.sparkSession.sparkContext.broadcast(frequent)

    def join(table):
        import pyarrow as pa

        made = lambda a, b, p: pa.table({"a": pa.array(a.view(np.int64)), "b": pa.array(b.view(np.int64)), "is_pair": pa.array(p)})
        key = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("keys")])
        node = np.concatenate([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("nodes")])
        if table.column("bucket")[0].as_py() < 0:
            # links that units made: as few as a spanning forest has
            nodes, at = np.unique(np.r_[key, node], return_inverse=True)
            label = local_components(len(nodes), at[: len(key)], at[len(key) :])
            star = np.flatnonzero(label != np.arange(len(nodes)))
            return made(nodes[star], nodes[label[star]], np.zeros(len(star), bool))
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        # a node that several units of the input have stands under its keys several times
        keep = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])]
        key, node = key[keep], node[keep]
        same = key[1:] == key[:-1]
        keep = np.r_[same, False] | np.r_[False, same]
        key, node = key[keep], node[keep]
        if not len(key):
            return made(key, node, np.zeros(0, bool))
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[start, len(key)])
        nodes, at = np.unique(node, return_inverse=True)
        long = np.repeat(sizes > FEW, sizes)
        label = local_components(len(nodes), at[long], np.repeat(at[start], sizes)[long])
        star = np.flatnonzero(label != np.arange(len(nodes)))
        pairs = []
        for j in range(1, FEW):
            first = start[(sizes > j) & (sizes <= FEW)]
            for i in range(j):
                a, b = at[first + i], at[first + j]
                apart = label[a] != label[b]
                pairs.append(np.unique(np.minimum(a, b)[apart] * len(nodes) + np.maximum(a, b)[apart]))
        pairs = np.unique(np.concatenate(pairs))
        a, b = np.r_[nodes[star], nodes[pairs // len(nodes)]], np.r_[nodes[label[star]], nodes[pairs % len(nodes)]]
        return made(a, b, np.r_[np.zeros(len(star), bool), np.ones(len(pairs), bool)])

    listed = _listed(_counted(_units(source, shared, light, buckets)), shared, light, buckets)
    return listed.groupBy("bucket").applyInArrow(join, "a bigint, b bigint, is_pair boolean")


def _may_be_among(source: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of source, less most of those whose key isn't among keys, so that their texts need not be shuffled for the join that decides.

    The filter is a bit map of fixed size (FILTER_BITS); where keys fill it, it lets all rows pass."""
    place = F.pmod(F.xxhash64("key"), F.lit(FILTER_BITS))
    words = keys.select(place.alias("p")).groupBy(F.shiftright("p", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    for r in words.collect():
        bits[r.w] = r.bits
    shared = source.sparkSession.sparkContext.broadcast(bits.view(np.uint64))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.column(2).to_numpy()
            there = (shared.value[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
            yield batch.select([0, 1]).filter(pa.array(there.astype(bool)))

    return source.withColumn("p", place).mapInArrow(run, source.schema)


def _possible_pairs(pairs: DataFrame, stats: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and sketches don't rule out."""
    sketches = stats.where("n > 0").select("node", "n", "sketch").dropDuplicates(["node"])
    side = lambda x: sketches.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= NEED * F.greatest("n_a", "n_b"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            most = (100 - NEED) * (batch.column(2).to_numpy() + batch.column(3).to_numpy()) // (100 + NEED)
            differ = sketch_differences(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(differ <= most))

    return sized.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a bigint, b bigint")


def jaccard_components(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row of documents."""
    small_batches(documents.sparkSession)
    key_type = documents.schema[key].dataType.simpleString()
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text"))
    stats = written(_statistics(source, key_type), "op1_stats")
    docs = stats.where("n >= 0").select("key", "n", "node")
    total = docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    often = stats.where("n = -1").groupBy("node").agg(F.sum("times").alias("times")).where(F.col("times") >= max(64, total // (2 * FREQUENT))).select("node")
    frequent = np.sort(np.array([r[0] for r in often.toLocalIterator()], np.int64).view(np.uint64))
    by_size = {r.n: r.times for r in docs.where(F.col("n").between(1, 2 * LIGHT_MOST)).groupBy("n").agg(F.count("*").alias("times")).collect()}
    found = written(_forests(source, light_boundary(by_size), frequent, parts_for(documents, text, BUCKET_BYTES, 16)), "op1_lists")
    pairs = _possible_pairs(found.where("is_pair").select("a", "b").distinct(), stats)
    edges = written(contract(found.where("not is_pair").select("a", "b")).unionByName(pairs), "op1_candidates")
    blocks = components(edges)

    # one text for each candidate node, and its part of its block
    reps = docs.where("n > 0").groupBy("node").agg(F.min("key").alias("key"), F.min("n").alias("n")).join(blocks, "node").withColumnRenamed("label", "block")
    reps = written(reps, "op1_members")
    sub = reps.groupBy("block").agg(F.ceil(F.greatest(F.count("*") / SUB_SETS, F.sum("n") / SUB_SHINGLES)).cast("int").alias("subs"), F.count("*").alias("times"))
    # one block may have a third of all nodes
    reps = join_hot(reps, sub, "block", reps.count()).withColumn("sub", F.pmod(F.xxhash64("node"), F.col("subs")).cast("int"))
    r = reps.withColumnRenamed("key", "rep_key")
    texts = _may_be_among(source, r.select(F.col("rep_key").alias("key"))).join(r, F.col("key").eqNullSafe(F.col("rep_key")))
    members = written(texts.select("block", "sub", "subs", "node", "n", "text"), "op1_texts")
    bins = max(16, reps.count() // 1000)
    inside = written(_inside(members, bins), "op1_inside")
    label = inside.select("node", "root", F.col("root").alias("label"))
    if members.where("subs > 1").take(1):
        label = _across(members.where("subs > 1"), inside)
        label = inside.select("node", "root").join(label, "root", "left").select("node", F.coalesce("label", "root").alias("label"))
    # smallest keys by node, then by label, so that rows of copies meet nothing but their own node, and hot ones of both without a shuffle
    own = docs.where("n > 0").groupBy("node").agg(F.min("key").alias("least"), F.count("*").alias("times"))
    nodes = written(own.join(label.select("node", "label"), "node", "left").withColumn("label", F.coalesce("label", "node")), "op1_nodes")
    found = written(nodes.groupBy("label").agg(F.min("least").alias("component_id"), F.count("*").alias("n_nodes"), F.sum("times").alias("rows")), "op1_components")
    n_rows, n_nodes = found.agg(F.coalesce(F.sum("rows"), F.lit(0)), F.coalesce(F.sum("n_nodes"), F.lit(0))).first()
    of_node = join_hot(nodes, found.drop("rows"), "label", n_nodes, "n_nodes").select("node", "component_id", "times")
    out = join_hot(docs.where("n > 0"), of_node, "node", n_rows).select("key", "n", "component_id")
    out = out.unionByName(docs.where("n = 0").select("key", "n", F.col("key").alias("component_id")))
    return out.select(F.col("key").alias(key), F.col("n").alias("n_shingles"), "component_id")


def _rows_of(table) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Nodes and sets of a table's rows, a row for each node, and the rows' places; rows whose text isn't the node's are left out."""
    node = table.column("node").to_numpy()
    sets = _sets_of_texts(table.column("text"))
    real = np.array([len(s) > 0 and node_ids(s, np.array([0, len(s)]))[0].view(np.int64) == x for s, x in zip(sets, node, strict=True)], bool)
    at = np.flatnonzero(real)
    at = at[np.unique(node[at], return_index=True)[1]]
    return node[at], [sets[i] for i in at], at


def _inside(members: DataFrame, bins: int) -> DataFrame:
    """(block, sub, subs, node, root, rank): components inside each part of a block; root is one of its nodes."""

    def run(table):
        import pyarrow as pa

        out = {k: [] for k in ("block", "sub", "subs", "node", "root", "rank")}
        block, sub, subs = (table.column(c).to_numpy() for c in ("block", "sub", "subs"))
        order = np.lexsort((sub, block))
        cut = np.flatnonzero(np.r_[True, (block[order][1:] != block[order][:-1]) | (sub[order][1:] != sub[order][:-1])])
        for a, b in zip(cut, np.r_[cut[1:], len(order)], strict=True):
            rows = table.take(pa.array(order[a:b]))
            node, sets, _ = _rows_of(rows)
            if not len(node):
                continue
            label, rank = compare(sets)
            best = {}
            for i in np.argsort(rank):
                best.setdefault(int(label[i]), i)
            root = node[[best[int(x)] for x in label]]
            same = order[a]
            for name, value in (("block", block[same]), ("sub", sub[same]), ("subs", subs[same])):
                out[name].append(np.full(len(node), value))
            out["node"].append(node)
            out["root"].append(root)
            out["rank"].append(rank)
        kinds = {"sub": pa.int32(), "subs": pa.int32()}
        return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, np.int64), kinds.get(k, pa.int64())) for k, v in out.items()})

    binned = members.withColumn("bin", F.pmod(F.xxhash64("block", "sub"), F.lit(bins)).cast("int"))
    return binned.groupBy("bin").applyInArrow(run, "block bigint, sub int, subs int, node bigint, root bigint, rank bigint")


def _linked_labels(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(a, b): labels of sets of left that link with sets of another label of right, in groups of equal keys."""

    def run(table):
        import pyarrow as pa

        side, got = table.column("side").to_numpy(), []
        for s in (0, 1):
            part = table.filter(pa.array(side == s))
            _, sets, at = _rows_of(part)
            got.append((sets, part.column("label").to_numpy()[at]))
        (ls, ll), (rs, rl) = got
        pairs = {(int(ll[i]), int(rl[j])) for i, j in cross_links(ls, rs, ll, rl)}
        return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})

    both = left.withColumn("side", F.lit(0)).unionByName(right.withColumn("side", F.lit(1)))
    return both.groupBy(*keys).applyInArrow(run, "a bigint, b bigint").distinct()


def _across(split: DataFrame, inside: DataFrame) -> DataFrame:
    """(root, label): components of the roots of split blocks.  Every set is compared with a few pivots of its block, and the sets that are still outside
    the block's main component with all its sets; two sets of the main component need no comparison."""
    own = inside.where("subs > 1")
    sizes = own.groupBy("block", "root").agg(F.count("*").alias("size"))
    largest = Window.partitionBy("block").orderBy(F.desc("size"), "root")
    pivots = sizes.withColumn("k", F.row_number().over(largest)).where(F.col("k") <= PIVOTS).select("block", F.col("root").alias("node"))
    parts = split.select("block", "sub").distinct()
    rows = split.join(own.select("node", "root"), "node").select("block", "sub", "node", "text", F.col("root").alias("label"))
    pivot_rows = rows.drop("sub").join(F.broadcast(pivots) if pivots.count() <= 10_000 else pivots, ["block", "node"]).dropDuplicates(["block", "node"])
    to_pivots = written(_linked_labels(rows, pivot_rows.join(parts, "block"), ["block", "sub"]), "op1_pivot_links")
    first = written(components(to_pivots), "op1_joined").select(F.col("node").alias("root"), "label")
    mine = own.select("block", "sub", "node", "root").join(first, "root", "left").select("block", "sub", "node", "root", F.coalesce("label", "root").alias("label"))
    of_label = mine.groupBy("block", "label").agg(F.count("*").alias("size"))
    main = of_label.groupBy("block").agg(F.max_by("label", F.struct("size", "label")).alias("main"), F.sum("size").alias("times"))
    outside = written(join_hot(mine, main, "block", own.count()).where("label <> main").select("block", "node", "label"), "op1_outside")
    if not outside.take(1):
        return first
    amount = outside.groupBy("block").agg(F.ceil(F.count("*") / REST).cast("int").alias("pieces"))
    numbered = outside.join(amount, "block").withColumn("piece", F.pmod(F.xxhash64("node", F.lit(1)), F.col("pieces")).cast("int"))
    pieces = amount.select("block", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    texts = split.select("node", "text")
    left = numbered.join(texts, "node").join(parts, "block").select("block", "sub", "piece", "node", "text", "label")
    right = mine.drop("root").join(pieces, "block").join(texts, "node").select("block", "sub", "piece", "node", "text", "label")
    second = components(written(_linked_labels(left, right, ["block", "sub", "piece"]), "op1_rest_links")).select(F.col("label").alias("final"), F.col("node").alias("label"))
    roots = mine.select("root", "label").distinct()
    return roots.join(second, "label", "left").select("root", F.coalesce("final", "label").alias("label"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents"))
