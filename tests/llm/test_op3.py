"""The language model against plain counting, and the coded levels against plain arrays."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_ops import ODD, SF, WORD, frame, lower

from reedbank.llm import op03_lm_trie as op
from reedbank.llm.elias_fano import Monotone, Successors


def plain(rows, held):
    """(key, held, n_tokens, n_known, train_tokens, base, score) by dictionaries."""
    tokens = [["\0b", "\0b", *WORD.findall(lower(t or "")), "\0e"] for _, t in rows]
    count, two, three, one_context, two_context = (collections.Counter() for _ in range(5))
    for t, h in zip(tokens, held, strict=True):
        if not h:
            count.update(t[2:])
            two.update(zip(t[1:], t[2:], strict=False))
            three.update(zip(t, t[1:], t[2:], strict=False))
            one_context.update(t[1:-1])
            two_context.update(zip(t, t[1:-1], strict=False))
    n, v = sum(count.values()), len(count)

    def p(a, b, c):
        p1 = max(1, count[c]) / (n + 1)
        p2 = (two[b, c] + op.MU2 * p1) / (one_context[b] + op.MU2)
        return (three[a, b, c] + op.MU3 * p2) / (two_context[a, b] + op.MU3)

    out = []
    for (k, _), t, h in zip(rows, tokens, held, strict=True):
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in t[2:])
        score = sum(math.log10(p(*x)) for x in zip(t, t[1:], t[2:], strict=False))
        out.append((k, h, len(t) - 2, sum(count[w] > 0 for w in t[2:]), n, base, score))
    return out


def check(got, want, varied=False):
    order = lambda r: (str(r[0]), r[2], r[5])
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=order)
    for g, w in zip(got, sorted(want, key=order), strict=True):
        assert g[:5] == w[:5] and g[5] == pytest.approx(w[5], rel=1e-9)
        # half a step of the trie and half a step of the answer for each token
        assert abs(g[6] - w[6]) <= 0.5 * (op.STEP + op.ANSWER_STEP) * w[2] + 1e-9
    # where probabilities vary, rounding errors do not lean to one side
    tokens = sum(w[2] for w in want)
    assert not varied or abs(sum(g[6] for g in got) - sum(w[6] for w in want)) <= 0.1 * op.STEP * tokens + op.STEP


def test_op3(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = docs[:120] + ODD
    train = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) != 2, F.lit(True))
    got = op.train_and_score(frame(spark, rows), train).collect()
    check(got, plain(rows, [k is not None and zlib.crc32(str(k).encode()) % 7 == 2 for k, _ in rows]), True)


def test_op3_spread_contexts(spark):
    """A context with a third of all tokens is spread over shards without changing any score."""
    rows = [(i, " ".join(f"the w{(i * 7 + j) % 50}" for j in range(20))) for i in range(60)]
    u = op.Unigrams(np.array([5, 9], np.uint64), [(5, 1200), (9, 300)], 2460, 52, 60, 12)
    assert list(u.spread) == [3, 4] and list(u.spread_total) == [1200, 300]
    held = [i % 5 == 0 for i in range(60)]
    got = op.train_and_score(frame(spark, rows), F.col("doc_id") % 5 != 0).collect()
    check(got, plain(rows, held))


def test_op3_every_word_counts(spark):
    """Behind 65,536 more frequent words, words seen once and words seen eight times are told apart."""
    rows = [(i, " ".join([f"v{i}x{j}" for j in range(660)] * 8 + [f"r{i}x{j}" for j in range(20)])) for i in range(100)]
    # pairs that training texts do not have, so that p(w) alone tells the words apart
    rows += [(1000 + i, " ".join(f"{c}{(j * 7) % 100}x{j % n}" for j in range(200))) for i, (c, n) in enumerate([("r", 20), ("v", 660)])] + [(2000, "never seen words here")]
    want = plain(rows, [k >= 1000 for k, _ in rows])
    assert want[0][4] > 1 << 16
    check(op.train_and_score(frame(spark, rows), F.col("doc_id") < 1000).collect(), want)


def test_small_probabilities(tmp_path):
    """A trigram seen once after a context seen 10**9 or 10**11 times is as rare as its counts say; levels work from a file as well."""
    ids, none = np.array([3, 4, 70_000, 1 << 40], np.uint64), np.zeros(0, np.int64)
    totals = np.array([10**9, 10**11])
    pairs = (np.array([0, 1]), np.array([2, 2]), np.array([1, 1]))
    triples = (np.array([0]), np.array([1]), np.array([2]), np.array([1]))
    trie = op.Trie.build(ids, np.array([1, 1, 1, 0]), np.array([0, 1]), totals, pairs, triples, 10**12)
    trie.save(str(tmp_path / "levels"))
    for t in (trie, op.Trie.open(str(tmp_path / "levels"), 10**12)):
        number, log_word, total = t.numbers(np.r_[ids, np.uint64(99)])
        assert list(number) == [0, 1, 2, 3, -1] and list(total) == [10**9, 10**11, 0, 0, 0] and np.allclose(log_word, -12)
        u, v, w = np.array([1, 0, 0, -1, 3]), np.array([0, 0, 1, 1, -1]), np.array([2, 2, 3, 2, 2])
        got = t.log10(u, v, w, log_word[w])
        p2 = [(1 + op.MU2 * 1e-12) / (x + op.MU2) for x in (10**9, 10**11)]
        want = [(1 + op.MU3 * p2[0]) / (1 + op.MU3), p2[0], op.MU2 * 1e-12 / (10**11 + op.MU2), p2[1], 1e-12]
        assert np.allclose(got, np.log10(want), atol=op.STEP / 2 + 1e-9)
    empty = op.Trie.build(ids[:0], none, none, none, (none,) * 3, (none,) * 4, 0)
    assert np.allclose(empty.log10(np.array([-1]), np.array([-1]), np.array([-1]), np.array([-2.0])), -2)


def test_levels():
    rng = np.random.default_rng(0)
    for n, top in ((1, 1), (5, 3), (700, 50), (3000, 1 << 48), (7, 0), (0, 5)):
        x = np.sort(rng.integers(0, top + 1, n))
        m = Monotone(Monotone.encode(x))
        assert (m.get(np.arange(n)) == x).all() and m.size == len(m.words)
        asked = np.r_[x, rng.integers(0, top + 5, 500)]
        lo = rng.integers(0, n + 1, len(asked))
        hi = np.maximum(lo, rng.integers(0, n + 1, len(asked)))
        at, hit = m.find(asked, lo, hi)
        assert [q in x[a:b] for q, a, b in zip(asked, lo, hi, strict=True)] == list(hit) and (x[at[hit]] == asked[hit]).all()
    lists = [sorted(set(rng.integers(0, 90, rng.integers(0, 12)).tolist())) for _ in range(200)]
    starts = np.r_[0, np.cumsum([len(x) for x in lists])]
    s = Successors(*map(Monotone, Successors.encode(starts, np.concatenate([np.array(x, np.int64) for x in lists]))))
    context, value = rng.integers(0, 200, 3000), rng.integers(0, 95, 3000)
    at, hit = s.find(s.ranges(context), value)
    assert [x in lists[c] for c, x in zip(context, value, strict=True)] == list(hit)
    assert (at[hit] == [starts[c] + lists[c].index(x) for c, x, h in zip(context, value, hit, strict=True) if h]).all()


def test_moved_words():
    ids = np.array([1, 2, 3, 65535, 65536, 1 << 47, 5, (1 << 48) - 1], np.uint64)
    assert (op.ids_in(*op.ids_out(ids)) == ids).all()
    for kind in (np.uint16, np.uint32, np.int64):
        x = np.array([0, 1, 60000, 7], kind)
        assert (op.unpacked(op.packed(x), kind) == x).all()
