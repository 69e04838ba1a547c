"""Contraction of trees as tables against the recursion in one process: balanced trees, chains, stars, combs, several rates and trees."""

import numpy as np
import pytest

from reedbank.kernels import likelihood, models

RATES = np.array([0.2, 0.7, 2.1])
MODELS = {"jc": models.jc69(), "hky": models.hky85([0.3, 0.2, 0.15, 0.35], 2.5)}


def parents(shape, n, rng):
    if shape == "balanced":
        return [-1] + [(i - 1) // 2 for i in range(1, n)]
    if shape == "chain":
        return [-1] + list(range(n - 1))
    if shape == "star":
        return [-1] + [0] * (n - 1)
    if shape == "comb":
        return [-1] + [(i - 1) if i % 2 else max(i - 2, 0) for i in range(1, n)]
    return [-1] + [int(rng.integers(0, i)) for i in range(1, n)]


CASES = [("chain", 20, "hky", None), ("star", 30, "hky", None), ("random", 30, "hky", RATES), ("one", 1, "jc", None)]


@pytest.mark.parametrize("shape,n,kind,rates", CASES)
def test_against_the_recursion(spark, shape, n, kind, rates):
    from reedbank.operators import contraction as op

    rng, model, width = np.random.default_rng(n), MODELS[kind], 3
    up = np.array(parents(shape, n, rng))
    length = np.round(rng.uniform(0, 1, n), 3)
    codes = rng.integers(-1, 4, (n, width)).astype(np.int8)
    tree = likelihood.Tree(up, length, codes)
    above, below = likelihood.messages(tree, model, rates)
    nodes = spark.createDataFrame([(i, None if up[i] < 0 else int(up[i]), float(length[i])) for i in range(n)], "id long, parent long, length double")
    # gaps are left out in part
    leaves = [(i, s + 1, "ACGT-"[codes[i, s]]) for i in range(n) if tree.is_leaf(i) for s in range(width) if codes[i, s] >= 0 or s % 2 or s == width - 1]
    sites = spark.createDataFrame(leaves, "id long, site int, base string")
    found = op.messages_up(nodes, sites, model, rates)
    for r in found.collect():
        assert np.allclose(np.log(np.maximum(r.l, 1e-300)) + r.ls, np.maximum(above[r.id][:, r.site - 1], np.log(1e-300) + r.ls), atol=1e-8)
    assert sorted((r.id, r.site) for r in found.collect()) == [(i, s + 1) for i in range(n) for s in range(width)]
    total = sum(r.loglik for r in op.site_loglik(found, model).collect())
    assert np.isclose(total, likelihood.tree_loglik(above[0], model), atol=1e-8)
    weights = op.state_weights(found, op.messages_down(found, model, rates), model, rates).collect()
    assert len(weights) == n * width
    for r in weights:
        want = likelihood.state_weights(likelihood.node_message(tree, above, below, r.id, model, rates))[:, r.site - 1]
        assert np.allclose([r.wa, r.wc, r.wg, r.wt], want, atol=1e-8)


def test_many_trees_and_long_chains(spark, monkeypatch):
    """Rounds follow the number of binary digits of the depth, and trees are contracted side by side."""
    from reedbank.operators import contraction as op

    n, rounds, plain = 200, [], op.stored
    monkeypatch.setattr(op, "stored", lambda df, name: rounds.append(name) or plain(df, name))
    rows = [(i, i - 1 if i else None, 0.01) for i in range(n)] + [(1000 + i, 1000 + (i - 1) // 2 if i else None, 0.1) for i in range(15)]
    nodes = spark.createDataFrame(rows, "id long, parent long, length double")
    sites = spark.createDataFrame([(n - 1, 1, "G")] + [(1000 + i, 1, "A") for i in range(7, 15)], "id long, site int, base string")
    up = op.messages_up(nodes, sites, MODELS["jc"])
    assert len(rounds) <= 12
    found = {r.root: r.loglik for r in op.site_loglik(up, MODELS["jc"]).collect()}
    assert np.isclose(found[0], np.log(0.25)) and -9 < found[1000] < -1.4
    states = {(r.id, r.base) for r in op.ancestral_states(op.weights_of(nodes, sites, MODELS["jc"])).collect()}
    assert states == {(i, "G") for i in range(n)} | {(1000 + i, "A") for i in range(15)}


def test_contradiction_without_length(spark):
    from reedbank.operators import contraction as op

    nodes = spark.createDataFrame([(0, None, 0.0), (1, 0, 0.0), (2, 0, 0.0), (3, 0, 0.5)], "id long, parent long, length double")
    sites = spark.createDataFrame([(1, 1, "A"), (2, 1, "C"), (3, 1, "C")], "id long, site int, base string")
    rows = op.weights_of(nodes, sites, MODELS["jc"]).collect()
    assert all(np.isfinite([r.wa, r.wc, r.wg, r.wt]).all() for r in rows)
