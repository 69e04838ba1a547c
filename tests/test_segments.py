"""Search of nearest rows by letters of segments against comparing all pairs, and how many pairs it compares."""

import numpy as np
import pytest


def by_all_pairs(ids, nodes, read, n):
    both = (nodes >= 0) & (read >= 0)
    differ, common = (both & (nodes != read)).sum(axis=1), both.sum(axis=1)
    return sorted((a / b, int(i)) for a, b, i in zip(differ, common, ids, strict=True) if b)[:n]


@pytest.mark.parametrize("width,gaps", [(32, False), (32, True), (6, True), (13, False), (40, True)])
def test_equals_all_pairs(width, gaps):
    """Gaps in reads and nodes, rows without a letter, many equal distances, whole and broken segments."""
    from reedbank.kernels.segments import Index

    rng = np.random.default_rng(width)
    nodes, ids = rng.integers(-1, 4, (1500, width)).astype(np.int8), rng.permutation(1500) * 3
    nodes[:5] = -1
    reads = rng.integers(-1 if gaps else 0, 4, (12, width)).astype(np.int8)
    reads[0], reads[1] = -1 if gaps else 0, nodes[700]
    for n in (1, 5):
        found = {i: [(d, int(x)) for x, d in zip(got, share, strict=True)] for i, got, share in Index(ids, nodes).nearest(reads, n)}
        assert found == {i: by_all_pairs(ids, nodes, reads[i], n) for i in range(12)}


def test_few_pairs_are_compared():
    from reedbank.kernels.segments import Index

    rng = np.random.default_rng(3)
    nodes, reads = rng.integers(-1, 4, (200_000, 32)).astype(np.int8), rng.integers(0, 4, (4, 32)).astype(np.int8)
    index, ids = Index(np.arange(200_000), nodes), np.arange(200_000)
    for i, got, share in index.nearest(reads, 5):
        assert list(zip(share, got, strict=True)) == by_all_pairs(ids, nodes, reads[i], 5)
    assert index.compared < 0.2 * 4 * 200_000


def test_large_parts_are_searched_by_segments(spark, monkeypatch):
    """Several blocks and parts; no matrix of all pairs is made."""
    from reedbank.operators import similarity

    rng = np.random.default_rng(4)
    codes = rng.integers(-1, 4, (320, 12))
    text = ["".join("ACGT-"[c] for c in row) for row in codes]
    reads, nodes = list(enumerate(text[:20])), [(i, t) for i, t in enumerate(text[20:])] + [(300, "------"), (301, None)]
    want = [(i, x, d) for i in range(20) for d, x in by_all_pairs(np.arange(300), codes[20:], codes[i], 4)]
    monkeypatch.setattr(similarity.Nearest, "add", lambda *_: pytest.fail("all pairs are compared"))
    for name, value in (("NODES_A_BLOCK", 50), ("BLOCK_BYTES", 1100), ("LEAST_INDEXED", 1), ("READS_A_SEARCH", 7)):
        monkeypatch.setattr(similarity, name, value, raising=False)
    tables = spark.createDataFrame(reads, "read long, seq string"), spark.createDataFrame(nodes, "id long, seq string")
    assert sorted(map(tuple, similarity.nearest_nodes(*tables, 4, 12).collect())) == sorted(want)
