"""Operator 12 against a plain trie."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def rebuilt(rows):
    """rows (conv, turn, role, text); the rebuilt turns of each conversation."""
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in own.items()}
    out = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - int(np.fmod(c, 5)), [])[:h] + own[c][h:]
    return out


def plain(rows):
    paths = rebuilt(rows)
    nodes = {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            nodes.setdefault(tuple(paths[c][:d]), []).append(c)
    children, leaves, saved = {}, {}, {}
    for p in sorted(nodes, key=len, reverse=True):
        leaves[p] = leaves.get(p, 0) or 1
        saved[p] = saved.get(p, 0) + ((len(nodes[p]) - 1) * len(p[-1][1].encode()) if p else 0)
        if p:
            up = p[:-1]
            children[up] = children.get(up, 0) + 1
            leaves[up] = leaves.get(up, 0) + leaves[p]
            saved[up] = saved.get(up, 0) + saved[p]
    sha = lambda p: hashlib.sha256(",".join(str(c) for c in nodes[p] if len(paths[c]) == len(p)).encode()).hexdigest()
    return [(m[0], len(p), nodes[p[:-1]][0] if p else None, len(m), children.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in nodes.items()]


def made(seed):
    """Families with common beginnings, copies, prefixes of others, ties, nulls and negative ids."""
    rng, out = random.Random(seed), []
    base = [("user", f"t{i} é") for i in range(12)]
    for c in range(-6, 120):
        if c in (10, 20, 45):
            continue
        kind = rng.randrange(6)
        turns = {0: base[: rng.randrange(1, 13)], 1: base[:4] + [("assistant", f"own {c}")] * rng.randrange(1, 4), 2: [("user", rng.choice("ab"))] * rng.randrange(1, 11), 3: [(None, None), ("user", "x")], 4: base, 5: [("user", f"{c} {i}") for i in range(rng.choice([1, 2, 30]))]}[kind]
        order = list(enumerate(turns))
        rng.shuffle(order)
        out += [(c, None if i == 0 and kind == 2 else (1 if kind == 3 else i), r, x) for i, (r, x) in order]
    return out


ORDER = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    return df.withColumns({c: F.lit(1) for c in ("conv", "pos", "cls", "m", "len", "part", "size", "rep", "key", "ends")})


@pytest.mark.parametrize("case", ["table", "made", "rounds", "one row", "hot"])
def test_against_a_plain_trie(spark, case, monkeypatch):
    from reedbank.llm import op12_prefix_trie as op

    table = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = {"table": table, "made": made(1), "rounds": made(2), "one row": [(7, 0, "user", "x"), (None, 0, "user", "y")]}.get(case)
    limit = {"rounds": 20, "hot": 50}.get(case)
    if case == "hot":
        # one conversation has a third of all rows, a third of all conversations are one, and their list goes block by block
        monkeypatch.setattr(op, "FEW_MEMBERS", 20)
        monkeypatch.setattr(op, "BLOCK", 7)
        rows = [(5000, i, "user", f"{i}") for i in range(700)] + [(5 * c, 0, "user", "copy") for c in range(200)] + [(5 * c + 1000, i, "user", f"a{min(i, c % 3)}") for c in range(160) for i in range(4)]
    got = [tuple(r) for r in op.conversation_trie(frame(spark, rows), local_rows=limit).select(*ORDER).collect()]
    assert sorted(got, key=str) == sorted(plain(rows), key=str)


def test_empty(spark):
    from reedbank.llm.op12_prefix_trie import conversation_trie

    for rows in ([], [(None, 1, "user", "x")]):
        assert conversation_trie(frame(spark, rows)).count() == 0


def test_spread_conversations(spark):
    """A conversation that lies in many parts is numbered through."""
    from reedbank.llm.op12_prefix_trie import numbered_turns

    rows = [(1, i, "user", f"{i}") for i in range(2000)] + [(c, 0, "user", "x") for c in range(2, 50)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = numbered_turns(frame(spark, rows).repartition(5))
        assert sorted(r.pos for r in got.where("conv = 1").collect()) == list(range(1, 2001))
        assert got.where("conv > 1 and pos = 1").count() == 48
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
