"""Operator 12: the prefix trie of conversations, by partition refinement.

A conversation is a sequence of turns, a turn is told by two 64-bit hashes of role and text and by the text's bytes; texts are moved once, to be sorted, and equal
conversations are one sequence with a multiplicity.  Refinement starts with one class of all sequences.  A class of more than LOCAL_ROWS turns is split by its next
turn in a round of joins and aggregations over all such classes; a class with one sequence is retired: the rest of it is a chain of nodes, made from its rows without more
rounds; the others are gathered in bins of about LOCAL_ROWS turns, and each bin is refined in a task turn by turn, again retiring single sequences.  Then children are
folded back into their parents, in tasks first and then level by level.  So rounds are as many as the depth down to which classes are large, not as the longest
conversation has turns.

No conversation or class is gathered as a whole unless it has fewer than LOCAL_ROWS turns: turns are numbered by range partitions and offsets between them, members of a node
whose conversations end there are hashed block by block in order.

Rows: a null role or text is empty.  Turns are ordered by (turn, role, text), a null turn first; repeated rows are turns of their own.  Rows with a null id belong to no
conversation and are left out.  Ids are cast to long.  Other columns are ignored, whatever their names.  An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from reedbank.llm.shared import join_hot, read_table, written

#: Turns that are refined at a time in a task.
LOCAL_ROWS = 200_000
#: Members of a node whose list is made as one value; longer lists are hashed block by block.
FEW_MEMBERS = 10_000
#: Ids in a block.
BLOCK = 4096
SHARED_TURNS = 9

NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends long"


def numbered_turns(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos from 1, h1, h2, size): turns by their place, as hashes.  Rows are sorted by range, so that a conversation of any length is spread; its places are those
    in each part and the sizes of its parts before."""
    clean = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{conv}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), clean(role).alias("role"), clean(text).alias("text")).where("conv is not null")
    order = ["conv", "turn", "role", "text"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    thin = rows.select("conv", F.monotonically_increasing_id().alias("at"), *_turn_hashes(F.col("role"), F.col("text")), F.octet_length("text").cast("long").alias("size"))
    thin = written(thin.withColumn("part", F.shiftright("at", 33)), "op12_thin")
    parts = thin.groupBy("conv", "part").agg(F.count("*").alias("n"))
    by_conv = W.partitionBy("conv")
    # a part's first and last conversation are the only ones that go on in another, so these are few
    spread = parts.withColumns({"parts": F.count("*").over(by_conv), "before": F.sum("n").over(by_conv.orderBy("part")) - F.col("n")}).where("parts > 1 and before > 0")
    inner = thin.withColumn("pos", F.row_number().over(W.partitionBy("conv", "part").orderBy("at")).cast("long"))
    placed = inner.join(F.broadcast(spread.select("conv", "part", "before")), ["conv", "part"], "left")
    return placed.select("conv", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "h1", "h2", "size")


def _turn_hashes(role: Column, text: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), role, text).alias("h1"), F.xxhash64(F.lit("other"), text, role).alias("h2")]


def borrowed(conv: Column) -> Column:
    """How many first turns a conversation takes from the first one of its five."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(SHARED_TURNS))


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of the rebuilt conversations, and (conv) of all: the first h turns of conversation c - c % 5 (all if it has fewer, none if there is none), then
    c's own behind its first h."""
    counts = written(turns.groupBy("conv").agg(F.count("*").alias("n")).withColumns({"h": borrowed(F.col("conv")), "base": F.col("conv") - F.col("conv") % 5}), "op12_counts")
    based = counts.join(counts.select(F.col("conv").alias("base"), F.col("n").alias("base_n")), "base", "left")
    gap = based.select("conv", F.col("n").alias("times"), (F.col("h") - F.least("h", F.coalesce("base_n", F.lit(0)))).alias("gap"))
    n_rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    own = join_hot(turns.where(F.col("pos") > borrowed(F.col("conv"))), gap, "conv", n_rows).select("conv", (F.col("pos") - F.col("gap")).alias("pos"), "h1", "h2", "size")
    heads = turns.where(F.col("pos") < SHARED_TURNS).withColumnRenamed("conv", "base").join(counts.select("conv", "base", "h"), "base").where("pos <= h")
    return own.unionByName(heads.select("conv", "pos", "h1", "h2", "size")), counts.select("conv")


def _sequences(turns: DataFrame, convs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (conv, rep, m), and sequences (rep, m, len): rep is the smallest of m equal conversations."""
    mixed = lambda *c: F.bit_xor(F.xxhash64(*c))
    told = turns.groupBy("conv").agg(mixed("pos", "h1", "h2").alias("d1"), mixed("h2", "pos", "h1").alias("d2"), F.count("*").alias("len"))
    zero = F.lit(0).cast("long")
    keyed = convs.join(told, "conv", "left").select("conv", F.struct(*[F.coalesce(c, zero).alias(c) for c in ("d1", "d2", "len")]).alias("key"))
    keyed = written(keyed, "op12_keys")
    groups = written(keyed.groupBy("key").agg(F.min("conv").alias("rep"), F.count("*").alias("m")), "op12_groups")
    members = join_hot(keyed, groups.select("key", "rep", "m", F.col("m").alias("times")), "key", keyed.count()).select("conv", "rep", "m")
    return members, groups.select("rep", "m", F.col("key.len").alias("len"))


def _gather(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices start[i] .. start[i] + count[i] - 1, one range behind the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(count) - count
    return np.repeat(start - before, count) + np.arange(total)


def refine(cls: np.ndarray, depth: np.ndarray, conv: np.ndarray, m: np.ndarray, size: list[np.ndarray], hashes: list[tuple[np.ndarray, np.ndarray]]):
    """Columns of nodes: of the classes (cls, depth) of sequences, and of all below them.  size and hashes: of each sequence's turns below its class.  The classes
    themselves (top) come without a parent, and with only what is saved below them."""
    order = np.lexsort((conv, depth, cls))
    cls, depth, conv, m = cls[order], depth[order], conv[order], m[order]
    lengths = np.array([len(size[i]) for i in order], np.int64)
    flat_size = np.concatenate([size[i] for i in order]) if len(order) else np.zeros(0, np.int64)
    one = np.concatenate([hashes[i][0] for i in order]) if len(order) else np.zeros(0, np.int64)
    two = np.concatenate([hashes[i][1] for i in order]) if len(order) else np.zeros(0, np.int64)
    start = np.cumsum(lengths) - lengths
    n = len(order)
    new = np.r_[True, (cls[1:] != cls[:-1]) | (depth[1:] != depth[:-1])][:n]
    node = np.cumsum(new) - 1
    tops = np.flatnonzero(new)
    # a level: conv, depth, parent's place among all nodes, n_convs, size of the last turn, the sequence that ends there (-1: none)
    levels = [(cls[tops], depth[tops], np.full(len(tops), -1), np.bincount(node, m, len(tops)).astype(np.int64), np.zeros(len(tops), np.int64), np.full(len(tops), -1))]
    levels[0][5][node[lengths == 0]] = np.flatnonzero(lengths == 0)
    chains, step, first = [], 0, 0
    active = np.arange(n)
    while True:
        # a class with one sequence is retired
        many = np.bincount(node[active] - first, minlength=1)
        alone = many[node[active] - first] == 1
        if alone.any():
            chains.append((active[alone], node[active[alone]], np.full(int(alone.sum()), step)))
        active = active[~alone]
        active = active[lengths[active] > step]
        if not len(active):
            break
        at = start[active] + step
        by = np.lexsort((conv[active], two[at], one[at], node[active]))
        active, at = active[by], at[by]
        up = node[active]
        new = np.r_[True, (up[1:] != up[:-1]) | (one[at[1:]] != one[at[:-1]]) | (two[at[1:]] != two[at[:-1]])]
        head = np.flatnonzero(new)
        own = np.cumsum(new) - 1
        first += len(levels[-1][0])
        ends = np.full(len(head), -1)
        done = lengths[active] == step + 1
        ends[own[done]] = active[done]
        levels.append((conv[active[head]], depth[active[head]] + step + 1, up[head], np.bincount(own, m[active], len(head)).astype(np.int64), flat_size[at[head]], ends))
        node[active] = own + first
        step += 1
    who, parent, done = (np.concatenate([c[i] for c in chains]) if chains else np.zeros(0, np.int64) for i in range(3))
    c_conv, c_depth, c_parent, c_convs, c_size, c_ends = (np.concatenate([level[i] for level in levels]) for i in range(6))
    saved = (c_convs - 1) * c_size
    saved[: len(tops)] = 0
    leaves, children = np.zeros(len(c_conv), np.int64), np.zeros(len(c_conv), np.int64)
    # chains: what is saved at a turn and all behind it
    rest = lengths[who] - done
    at = _gather(start[who] + done, rest)
    owner = np.repeat(np.arange(len(who)), rest)
    each = flat_size[at] * (m[who[owner]] - 1)
    run = np.cumsum(each)
    upto = np.cumsum(rest)
    total = np.r_[0, run][upto] - np.r_[0, run][upto - rest]
    below = np.r_[0, run][upto][owner] - run + each
    place = np.arange(len(at)) - (upto - rest)[owner] + done[owner] + 1
    saved[parent] += total
    children[parent] += rest > 0
    # then from the deepest level up
    ends_at = np.cumsum([len(level[0]) for level in levels])
    for k in range(len(levels) - 1, -1, -1):
        a, b = ends_at[k] - len(levels[k][0]), ends_at[k]
        # a node without longer sequences is a leaf, and so is a chain's last
        leaves[a:b] = np.where(leaves[a:b] == 0, 1, leaves[a:b])
        if k:
            up = c_parent[a:b]
            np.add.at(children, up, 1)
            np.add.at(leaves, up, leaves[a:b])
            np.add.at(saved, up, saved[a:b])
    seq, inner = who[owner], len(c_conv)
    ends = np.r_[c_ends, np.where(place == lengths[seq], seq, -1)]
    parents, none = np.r_[c_parent, np.zeros(len(at), np.int64)] < 0, np.zeros(0, np.int64)
    return {
        "conv_id": np.r_[c_conv, conv[seq]], "depth": np.r_[c_depth, depth[seq] + place], "parent_conv_id": np.ma.array(np.r_[c_conv[c_parent] if inner else none, conv[seq]], mask=parents),
        "n_convs": np.r_[c_convs, m[seq]], "n_children": np.r_[children, (place < lengths[seq]).astype(np.int64)], "n_leaves": np.r_[leaves, np.ones(len(at), np.int64)],
        "saved_tokens": np.r_[saved, below], "ends": np.ma.array(conv[ends] if len(conv) else none, mask=ends < 0), "top": np.arange(len(ends)) < len(tops),
    }


def _refine_bins(rows: DataFrame) -> DataFrame:
    """Nodes of the bins of rows (bin, cls, depth, conv, m, pos, h1, h2, size): a row without pos for a sequence that ends with its class."""

    def run(table):
        import pyarrow as pa

        t = {c: table.column(c).to_numpy() for c in ("cls", "depth", "conv", "m")}
        pos = table.column("pos").fill_null(0).to_numpy()
        h1, h2, size = (table.column(c).fill_null(0).to_numpy() for c in ("h1", "h2", "size"))
        order = np.lexsort((pos, t["conv"]))
        conv = t["conv"][order]
        cut = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
        bounds = np.r_[cut, len(conv)]
        some = pos[order] > 0
        spans = [order[a:b][some[a:b]] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        one = {c: t[c][order][cut] for c in t}
        out = refine(one["cls"], one["depth"], one["conv"], one["m"], [size[s] for s in spans], [(h1[s], h2[s]) for s in spans])
        return pa.table({c: pa.array(np.ma.getdata(x), mask=np.ma.getmaskarray(x)) for c, x in out.items()})

    return rows.groupBy("bin").applyInArrow(run, NODE + ", top boolean")


def _member_digests(members: DataFrame) -> DataFrame:
    """(ends, ends_sha256) for each sequence: the digest of its members' ids, ascending, with commas between."""
    sha = lambda c: F.sha2(c.cast("binary"), 256).alias("ends_sha256")
    single = members.where("m = 1").select(F.col("rep").alias("ends"), sha(F.col("conv").cast("string")))
    few = members.where((F.col("m") > 1) & (F.col("m") <= FEW_MEMBERS)).groupBy("rep").agg(F.array_sort(F.collect_list("conv")).alias("ids"))
    few = few.select(F.col("rep").alias("ends"), sha(F.array_join(F.col("ids").cast("array<string>"), ",")))

    def blocks(batches):
        import pyarrow as pa

        def cut(rep, ids):
            return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array(ids[:1], pa.int64()), pa.array([",".join(map(str, ids))])], names=["rep", "first", "ids"])

        now, held = None, []
        for batch in batches:
            for rep, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if held and (rep != now or len(held) == BLOCK):
                    yield cut(now, held)
                    held = []
                now = rep
                held.append(conv)
        if held:
            yield cut(now, held)

    def hashed(batches):
        import pyarrow as pa

        def out(rep, state):
            return pa.RecordBatch.from_arrays([pa.array([rep], pa.int64()), pa.array([state.hexdigest()])], names=["ends", "ends_sha256"])

        now, state = None, None
        for batch in batches:
            for rep, ids in zip(batch.column(0), batch.column(1), strict=True):
                rep, ids = rep.as_py(), ids.as_py().encode()
                if state is not None and rep == now:
                    state.update(b"," + ids)
                    continue
                if state is not None:
                    yield out(now, state)
                now, state = rep, hashlib.sha256(ids)
        if state is not None:
            yield out(now, state)

    many = members.where(F.col("m") > FEW_MEMBERS).select("rep", "conv").repartitionByRange("rep", "conv").sortWithinPartitions("rep", "conv")
    many = many.mapInArrow(blocks, "rep long, first long, ids string").repartition("rep").sortWithinPartitions("rep", "first").select("rep", "ids")
    return single.unionByName(few).unionByName(many.mapInArrow(hashed, "ends long, ends_sha256 string"))


def _tails(alone: DataFrame, turns: DataFrame) -> DataFrame:
    """Chains of nodes below retired classes alone (conv, depth, m, len): from their sequences' turns, and (top) what is below the classes."""
    rows = turns.join(alone, "conv").where("pos > depth")
    # only copies save something; their sums run from the end of a sequence
    backwards = W.partitionBy("conv").orderBy(F.desc("pos"))
    copies = rows.where("m > 1").withColumn("saved_tokens", (F.col("m") - 1) * F.sum("size").over(backwards))
    rows = rows.where("m = 1").withColumn("saved_tokens", F.lit(0).cast("long")).unionByName(copies)
    last = F.col("pos") == F.col("len")
    one = F.lit(1).cast("long")
    nodes = rows.select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.col("conv").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), "saved_tokens", F.when(last, F.col("conv")).alias("ends"), F.lit(False).alias("top"),
    )
    sums = rows.where(F.col("pos") == F.col("depth") + 1).select("conv", "saved_tokens")
    ended = F.col("len") == F.col("depth")
    tops = alone.join(sums, "conv", "left").select(
        F.col("conv").alias("conv_id"), "depth", F.lit(None).cast("long").alias("parent_conv_id"), F.col("m").alias("n_convs"), F.when(ended, 0).otherwise(1).cast("long").alias("n_children"),
        one.alias("n_leaves"), F.coalesce("saved_tokens", F.lit(0)).cast("long").alias("saved_tokens"), F.when(ended, F.col("conv")).alias("ends"), F.lit(True).alias("top"),
    )
    return nodes.unionByName(tops)


def trie_nodes(turns: DataFrame, sequences: DataFrame, local_rows: int | None = None) -> DataFrame:
    """Nodes of the trie of sequences (rep, m, len) with turns (conv: a rep, pos, h1, h2, size); ends: the sequence that ends there, or null."""
    spark, local_rows = turns.sparkSession, local_rows or LOCAL_ROWS
    root = sequences.agg(F.min("rep")).first()[0]
    if root is None:
        return spark.createDataFrame([], NODE)
    now = sequences.select(F.col("rep").alias("conv"), "m", "len", F.lit(root).cast("long").alias("cls"))
    classes, alone, local, depth = [], None, None, 0
    # what is known of the classes of a level: their parents, and their last turn's bytes; the root has neither
    known = None
    join = lambda a, b: b if a is None else a.unionByName(b)
    while True:
        sums = now.groupBy("cls").agg(
            F.count("*").alias("n"), F.sum("m").alias("n_convs"), F.sum(F.col("len") - depth).alias("rows"), F.max(F.when(F.col("len") == depth, F.col("conv"))).alias("ends")
        )
        kind = F.when(F.col("n") == 1, "alone").when(F.col("rows") <= local_rows, "local").otherwise("large")
        level = sums.withColumn("kind", kind)
        level = level.withColumns({"parent": F.lit(None).cast("long"), "size": F.lit(0).cast("long")}) if known is None else level.join(known, "cls")
        level = written(level, "op12_level")
        classes.append(level)
        kinds = level.groupBy("kind").agg(F.sum("n").alias("n")).collect()
        n_rows, has = sum(r.n for r in kinds), {r.kind for r in kinds}
        told = now.withColumn("depth", F.lit(depth).cast("long"))
        if "alone" in has:
            # such a class has the name of its sequence
            alone = join(alone, told.join(level.where("kind = 'alone'").select("cls"), "cls", "left_semi").select("conv", "depth", "m", "len"))
        if "local" in has:
            local = join(local, told.join(level.where("kind = 'local'").select("cls"), "cls", "left_semi").select("conv", "depth", "m", "len", "cls"))
        if "large" not in has:
            break
        # few classes are large: each has over local_rows turns
        large = now.where(F.col("len") > depth).join(level.where("kind = 'large'").select("cls"), "cls", "left_semi")
        depth += 1
        step = turns.where(F.col("pos") == depth).select("conv", "h1", "h2", "size")
        keyed = written(large.join(step, "conv").select("conv", "m", "len", "size", F.struct("cls", "h1", "h2").alias("key")), "op12_split")
        split = written(keyed.groupBy("key").agg(F.min("conv").alias("cls"), F.first("size").alias("size"), F.count("*").alias("times")), "op12_classes")
        now = written(join_hot(keyed.select("conv", "m", "len", "key"), split.select("key", "cls", "times"), "key", n_rows).select("conv", "m", "len", "cls"), "op12_active")
        known = split.select("cls", F.col("key.cls").alias("parent"), "size")
    made = None
    if alone is not None:
        made = _tails(alone, turns)
    if local is not None:
        bins = max(1, level_rows(classes) // local_rows + 1)
        # a sequence that ends with its class has one row, without a turn
        below = turns.select(F.col("conv").alias("of"), "pos", "h1", "h2", "size")
        rows = local.join(below, (F.col("conv") == F.col("of")) & (F.col("pos") > F.col("depth")), "left").drop("of")
        rows = rows.withColumn("bin", F.pmod(F.xxhash64("cls", "depth"), F.lit(bins))).repartition(bins, "bin")
        made = join(made, _refine_bins(rows))
    made = written(made, "op12_nodes")
    tops = made.where("top").select("conv_id", "depth", "n_children", "n_leaves", "saved_tokens")
    out, below = made.where("not top").drop("top"), None
    for depth in range(len(classes) - 1, -1, -1):
        level = classes[depth]
        here = tops.where(F.col("depth") == depth).select(F.col("conv_id").alias("cls"), "n_children", "n_leaves", "saved_tokens")
        here = here if below is None else here.unionByName(below)
        saved = (F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("size")).alias("saved_tokens")
        nodes = written(level.join(here, "cls").select("cls", "parent", "n_convs", "n_children", "n_leaves", saved, "ends"), "op12_folded")
        below = nodes.where("parent is not null").groupBy(F.col("parent").alias("cls")).agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
        out = out.unionByName(nodes.select(F.col("cls").alias("conv_id"), F.lit(depth).cast("long").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends"))
    return out


def level_rows(classes: list[DataFrame]) -> int:
    """Turns in the classes that are refined in tasks."""
    return sum(level.where("kind = 'local'").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0] for level in classes)


def conversation_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", local_rows: int | None = None) -> DataFrame:
    """A row for each node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens (in its subtree), ends_sha256."""
    turns, convs = rebuilt_turns(numbered_turns(df, conv, turn, role, text))
    turns = written(turns, "op12_rebuilt")
    members, sequences = _sequences(turns, convs)
    sequences = written(sequences, "op12_sequences")
    kept = written(turns.join(sequences.select(F.col("rep").alias("conv")), "conv", "left_semi"), "op12_turns")
    nodes = trie_nodes(kept, sequences, local_rows)
    ended = nodes.where("ends is not null").join(_member_digests(members), "ends")
    return ended.unionByName(nodes.where("ends is null").withColumn("ends_sha256", F.lit(hashlib.sha256().hexdigest()))).drop("ends")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read_table(spark, sf_dir, "conversations"))
