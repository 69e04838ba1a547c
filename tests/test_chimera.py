"""The chimera scan against all breakpoints and pairs of nodes."""

import numpy as np
import pytest


@pytest.mark.parametrize("least", [1, 3])
def test_against_all_pairs(spark, least):
    from reedbank.operators import chimera

    rng = np.random.default_rng(least)
    rows, want = [], {}
    for read in range(12):
        nodes, n = sorted(rng.choice(100, rng.integers(1, 5), replace=False).tolist()), int(rng.integers(2, 12))
        # few values, so that many sums are equal; sites have gaps between them
        x = rng.integers(-3, 1, (len(nodes), n)) / 4
        rows += [(read, nodes[j], 5 + 2 * i, float(x[j, i])) for j in range(len(nodes)) for i in range(n)]
        best = None
        for b in range(least, n - least + 1):
            left, right = x[:, :b].sum(1), x[:, b:].sum(1)
            j, k = int(np.argmax(left)), int(np.argmax(right))
            if best is None or left[j] + right[k] > best[0]:
                best = (left[j] + right[k], 5 + 2 * (b - 1), nodes[j], nodes[k], left[j] + right[k] - x.sum(1).max(), left[j] - left[k] + right[k] - right[j])
        if best and len(nodes) > 1:
            want[read] = best[1:]
    got = {r.read: tuple(r)[1:] for r in chimera.scan(spark.createDataFrame(rows, "read int, node int, site int, loglik double"), least).collect()}
    assert set(got) == set(want) and all(np.allclose(got[r], want[r]) for r in want)


def test_made_chimeras_are_found(spark):
    """Reads of two leaves of a tree, by the states that the whole tree gives its nodes."""
    from reedbank.kernels.models import jc69
    from reedbank.operators import chimera, contraction

    rng = np.random.default_rng(0)
    seqs = {i: "".join(rng.choice(list("ACGT"), 60)) for i in range(3, 7)}
    nodes = spark.createDataFrame([(0, None, 0.0), *[(i, (i - 1) // 2, 0.2) for i in range(1, 7)]], "id long, parent long, length double")
    leaves = spark.createDataFrame(list(seqs.items()), "id long, aln string")
    weights = contraction.weights_of(nodes, contraction.leaf_sites(leaves), jc69())
    reads = {1: seqs[3][:25] + seqs[6][25:], 2: seqs[4]}
    rows = [(r, u, i + 1, c) for r, s in reads.items() for u in range(7) for i, c in enumerate(s)]
    got = {r.read: r for r in chimera.scan(chimera.site_scores(spark.createDataFrame(rows, "read long, node long, site int, base string"), weights, jc69())).collect()}
    assert (got[1].five, got[1].three) == (3, 6) and abs(got[1].site - 25) <= 2 and got[1].lod > 50 and got[1].gain > 20
    assert got[2].gain < 1e-6


def test_nothing(spark):
    from reedbank.operators import chimera

    assert chimera.scan(spark.createDataFrame([], "read int, node int, site int, loglik double")).count() == 0
