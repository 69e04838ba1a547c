"""Trees by whole subtrees in tasks against the recursion in one process, and what is written on the way."""

import numpy as np
import pytest
from test_contraction import MODELS, RATES, parents

from reedbank.kernels import likelihood


def ladder(n, below):
    """A chain of n nodes, under each of them a balanced subtree."""
    up = [-1, *range(n - 1)]
    for i in range(n):
        first = len(up)
        up += [i] + [first + (k - 1) // 2 for k in range(1, below)]
    return up


def made(spark, up, kind, width, letters):
    """The tree for the kernel and as tables, beside it a tree whose root's parent isn't in the table."""
    rng, model, n = np.random.default_rng(len(up)), MODELS[kind], len(up)
    up = np.array(up)
    length = np.round(rng.uniform(0, 1, n), 3)
    codes = rng.integers(-1, 4, (n, width)).astype(np.int8)
    codes[:, -1] = np.maximum(codes[:, -1], 0)
    own = likelihood.Tree(up, length, codes)
    lost = [(5000, 4999, 0.1), (5001, 5000, 0.1), (5002, 5000, 0.1)]
    nodes = spark.createDataFrame([(i, None if up[i] < 0 else int(up[i]), float(length[i])) for i in range(n)] + lost, "id long, parent long, length double")
    rows = [(i, "".join("ACGT-"[c] for c in codes[i])) for i in range(n) if own.is_leaf(i)] + [(5001, "ACGTA"[:width]), (5002, "ACCCC"[:width])]
    if letters:
        return model, own, nodes, spark.createDataFrame(rows, "id long, seq string")
    return model, own, nodes, spark.createDataFrame([(i, s + 1, b) for i, text in rows for s, b in enumerate(text) if b != "-" or s % 2], "id long, site int, base string")


CASES = [
    ("levels", parents("balanced", 63, None), "hky", RATES, True, 3), ("random", parents("random", 40, np.random.default_rng(1)), "hky", RATES, False, None),
    ("ladder", ladder(12, 7), "hky", None, True, 1), ("chain", parents("chain", 20, None), "jc", None, False, 0), ("star", parents("star", 30, None), "hky", None, True, None),
]


@pytest.mark.parametrize("name,up,kind,rates,letters,levels", CASES, ids=[c[0] for c in CASES])
def test_against_the_recursion(spark, monkeypatch, name, up, kind, rates, letters, levels):
    from reedbank.operators import contraction as op

    monkeypatch.setattr(op, "SITES_A_BLOCK", 2)
    monkeypatch.setattr(op, "CELLS_A_SUBTREE", 14)
    monkeypatch.setattr(op, "CELLS_A_FOREST", 10)
    monkeypatch.setattr(op, "CELLS_A_TASK", 100)
    model, own, nodes, leaves = made(spark, up, kind, 5, letters)
    parts = op.Subtrees(nodes, leaves, model, rates)
    assert levels is None or len(parts.levels) == levels
    assert (parts.rest is None) == (name == "levels")
    above, below = likelihood.messages(own, model, rates)
    total = sum(r.loglik for r in op.site_loglik(parts.at_roots(), model).collect() if r.root < 5000)
    assert np.isclose(total, likelihood.tree_loglik(above[0], model), atol=1e-8)
    found = parts.weights().collect()
    assert len(found) == len({(r.id, r.site) for r in found}) == len(up) * 5
    for r in found:
        want = likelihood.state_weights(likelihood.node_message(own, above, below, r.id, model, rates))[:, r.site - 1]
        assert np.allclose([r.wa, r.wc, r.wg, r.wt], want, atol=1e-8)


def test_sites_are_not_written_by_node(spark, monkeypatch):
    """Rows that are written while states are found follow nodes, not nodes times sites."""
    from reedbank.operators import contraction as op
    from reedbank.operators import tree

    rows, plain = [], op.stored
    for module in (op, tree):
        monkeypatch.setattr(module, "stored", lambda df, name: rows.append((name, (out := plain(df, name)).count())) or out, raising=False)
    monkeypatch.setattr(op, "CELLS_A_SUBTREE", 64 * 40, raising=False)
    n, width = 500, 40
    nodes = spark.createDataFrame([(i, (i - 1) // 2 if i else None, 0.1) for i in range(n)], "id long, parent long, length double")
    sites = spark.createDataFrame([(i, s, "ACGT"[(i + s) % 4]) for i in range(n // 2, n) for s in range(1, width + 1)], "id long, site int, base string")
    assert op.weights_of(nodes, sites, MODELS["jc"]).count() == n * width
    assert sum(x for _, x in rows) < n * width
