"""Kernels against brute force and identities."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reedbank.kernels import dirichlet, hmm, likelihood, models, special

PI = np.array([0.3, 0.2, 0.15, 0.35])
MODELS = [models.jc69(), models.k80(2.0), models.f81(PI), models.hky85(PI, 3.0), models.tn93(PI, 2.0, 4.0), models.gtr(PI, np.arange(16).reshape(4, 4) + 1.0)]


@pytest.mark.parametrize("m", MODELS, ids=lambda m: m.kind)
class TestModels:
    def test_probabilities(self, m):
        p = m.probability(np.array([0.1, 0.3, 0.4]))
        assert np.allclose(p.sum(-1), 1) and np.allclose(p[0] @ p[1], p[2]) and np.allclose(m.pi @ p[1], m.pi)

    def test_mean_rate_is_one(self, m):
        assert np.isclose(-(m.pi * np.diag(m.q)).sum(), 1)

    def test_distance_inverts_probability(self, m):
        assert np.isclose(m.distance(m.pi[:, None] * m.probability(0.2) * 1e6), 0.2)

    def test_text_form(self, m):
        assert np.allclose(models.read_model(models.write_model(m)).q, m.q, atol=1e-6)

    def test_training_recovers_ratios(self, m):
        counts = m.pi[:, None] * m.probability(0.02) * 1e6
        assert np.allclose(models.train(m.kind, counts, m.pi).q, m.q, atol=0.05)


def test_gamma_rates_have_mean_one():
    assert np.isclose(models.gamma_rates(4, 0.5).mean(), 1) and np.allclose(models.gamma_rates(4, 1e6), 1, atol=0.01)
    assert np.isclose(models.gamma_shape([1, 5, 9, 2]), 4.25**2 / (np.var([1, 5, 9, 2], ddof=1) - 4.25)) and models.gamma_shape([2]) == np.inf


@settings(max_examples=50, deadline=None)
@given(st.floats(0.1, 20), st.floats(0.01, 0.99))
def test_incomplete_gamma_inverse(a, p):
    assert abs(special.gamma_p(a, special.gamma_p_inverse(a, p)) - p) < 1e-8


def test_digamma():
    assert np.isclose(special.digamma(1.0), -0.5772156649015329) and np.isclose(special.digamma(0.5), -1.9635100260214235)


PARENT = np.array([-1, 0, 0, 1, 1, 2, 2, 3, 3, 0])


@pytest.mark.parametrize("m", MODELS, ids=lambda m: m.kind)
@pytest.mark.parametrize("rates", [None, np.array([0.5, 1.5])], ids=["one rate", "two rates"])
def test_likelihood_is_the_sum_over_inner_states(m, rates):
    rng = np.random.default_rng(1)
    length = rng.random(10) * 0.5
    tree = likelihood.Tree(PARENT, length, rng.integers(0, 4, (10, 3)).astype(np.int8))
    tree.codes[9, 1] = -2
    up, down = likelihood.messages(tree, m, rates)
    if rates is not None:
        # by definition: at each inner node the mean over rates of the product over children
        def below(u, site):
            if tree.is_leaf(u):
                return m.pi if tree.codes[u, site] < 0 else np.eye(4)[tree.codes[u, site]]
            return np.mean([np.prod([m.probability(length[c] * r) @ below(c, site) for c in tree.children[u]], axis=0) for r in rates], axis=0)

        assert np.isclose(likelihood.tree_loglik(up[0], m), sum(np.log(m.pi @ below(0, j)) for j in range(3)))
        return
    inner = [i for i in range(10) if not tree.is_leaf(i)]
    total = 0.0
    for site in range(3):
        p_site = 0.0
        for states in itertools.product(range(4), repeat=len(inner)):
            x = dict(zip(inner, states, strict=True))
            p = m.pi[x[0]]
            for i in range(1, 10):
                row = m.probability(length[i])[x[PARENT[i]]]
                c = x.get(i, tree.codes[i, site])
                p *= row[c] if c >= 0 else (row * m.pi).sum()
            p_site += p
        total += np.log(p_site)
    assert np.isclose(likelihood.tree_loglik(up[0], m), total)
    for u in range(1, 10):  # the same from every edge
        there = up[u] + likelihood.convolve([down[u]], [length[u]], m)
        assert np.isclose(likelihood.tree_loglik(there, m), total)


def test_placement_finds_the_branch_and_the_chimera():
    rng, m, n = np.random.default_rng(1), MODELS[0], 31
    parent = np.array([-1] + [(i - 1) // 2 for i in range(1, n)])
    seqs = np.zeros((n, 300), np.int8)
    seqs[0] = rng.integers(0, 4, 300)
    for i in range(1, n):
        seqs[i] = [rng.choice(4, p=m.probability(0.08)[c]) for c in seqs[parent[i]]]
    placer = likelihood.Placer(likelihood.Tree(parent, np.full(n, 0.08), seqs), m)
    for u in (15, 20, 30):
        read = np.array([rng.choice(4, p=m.probability(0.02)[c]) for c in seqs[u]], np.int8)
        found = placer.place(read, 20, 280, 10)
        assert found[0].child == u and all(found[0].loglik >= p.loglik for p in found)
    lod, five, three = placer.chimera(np.concatenate([seqs[15][:150], seqs[29][150:]]), 0, 300, n=10)
    assert (five, three) == (15, 29) and lod > 50
    assert placer.chimera(seqs[15], 0, 300, n=10)[0] < 1e-6


def test_refined_likelihood_is_not_the_number_of_sites():
    """The likelihood of a refined placement is that of the data: it is larger for a better read."""
    m = MODELS[0]
    tree = likelihood.Tree(np.array([-1, 0, 0]), np.array([0, 0.1, 0.1]), np.array([[0] * 20, [0] * 20, [1] * 20], np.int8))
    placer = likelihood.Placer(tree, m)
    good, bad = (placer.place(np.full(20, c, np.int8), 0, 20, 2)[0].loglik for c in (0, 3))
    assert good > bad + 5


def test_slack_filters_drop_candidates():
    rng = np.random.default_rng(0)
    tree = likelihood.Tree(np.array([-1, 0, 0, 0]), np.full(4, 0.1), np.array([[0] * 30, [0] * 30, rng.integers(0, 4, 30), [3] * 30], np.int8))
    placer = likelihood.Placer(tree, MODELS[0])
    read = np.zeros(30, np.int8)
    assert len(placer.seeds(read, 0, 30, 50)) == 3 and [u for u, _ in placer.seeds(read, 0, 30, 50, max_diff=0.1)] == [1]


def test_posteriors_sum_to_one():
    q, by_taxon = likelihood.posteriors([-10.0, -11.0, -12.0], ["a", "b", "a"])
    assert np.isclose((1 - 10 ** (-q / 10)).sum(), 1) and by_taxon[0] == by_taxon[2] and by_taxon[0] > q[0]
    assert likelihood.posteriors([-3.0], ["a"])[0][0] == 250


def random_profile(rng, k, mode):
    t = np.hstack([rng.dirichlet([5, 1, 1], k + 1), rng.dirichlet([1, 1], k + 1), rng.dirichlet([1, 1], k + 1)])
    t[0, hmm.DM], t[0, hmm.DD] = 1, 0
    t[k, hmm.MD], t[k, hmm.DM], t[k, hmm.DD] = 0, 1, 0
    return hmm.Profile(rng.dirichlet(np.ones(4), k + 1), rng.dirichlet(np.ones(4), k + 1), t, np.arange(k + 1), k, mode=mode)


def cheapest_path(p, x):
    a, n, k, best = hmm.Aligner(p), len(x), p.size, [np.inf]
    t = a.t

    def go(state, i, j, c):
        out = a.c_loop * (n - i) if n > i else 0
        if state == "M":
            best[0] = min(best[0], c + a.leave[j] + out)
        if state == "I" and j == k:
            best[0] = min(best[0], c + t[hmm.IM, k] + out)
        to_m, to_i, to_d = {"M": (hmm.MM, hmm.MI, hmm.MD), "I": (hmm.IM, hmm.II, None), "D": (hmm.DM, None, hmm.DD)}[state]
        if i < n and j < k:
            go("M", i + 1, j + 1, c + t[to_m, j] + a.em[j + 1, x[i]])
        if i < n and to_i is not None:
            go("I", i + 1, j, c + t[to_i, j] + a.ei[j, x[i]])
        if to_d is not None and j + 1 < k:
            go("D", i, j + 1, c + t[to_d, j])

    for i in range(1, n + 1):
        for j in range(1, k + 1):
            go("M", i, j, a.n_out + (a.n_loop * (i - 1) if i > 1 else 0) + a.enter[j] + a.em[j, x[i - 1]])
    return best[0]


@pytest.mark.parametrize("mode", hmm.MODES)
@pytest.mark.parametrize("k", [1, 2, 4])
def test_viterbi_is_the_cheapest_path(mode, k):
    rng = np.random.default_rng(k)
    p = random_profile(rng, k, mode)
    for n in (1, 3, 5):
        reads = rng.integers(0, 4, (3, n))
        for (value, _), x in zip(hmm.Aligner(p).align(reads), reads, strict=True):
            assert np.isclose(min(value, hmm.FAR), min(cheapest_path(p, x), hmm.FAR))


ROWS = ["ACGTACGT--ACGT", "ACGTAC-T--ACGA", "ACGAACGTA-ACGT", "A-GTACGT--ACGT"] * 5


def test_profile_training_and_alignment():
    p = hmm.build(hmm.count_alignment(ROWS), dirichlet.Prior.flat(), 1.0, "x")
    assert p.size == 12 and abs(p.mean_entropy() - 1) < 1e-4
    q = hmm.read_profile(hmm.write_profile(p))
    assert np.allclose(q.em[1:], p.em[1:], atol=1e-4) and np.allclose(q.t, p.t, atol=1e-4) and list(q.columns) == list(p.columns)
    a = hmm.Aligner(p)
    of = lambda s: a.to_alignment(s, a.align(np.array([["ACGT".index(c) for c in s]]))[0]).alignment
    assert of("ACGTACGTACGT") == "ACGTACGT--ACGT" and of("ACGTACTACGT") == "ACGTAC-T--ACGT" and of("ACGTACGTGGACGT") == "ACGTACGTggACGT"
    p.mode = "LOCAL"
    a = hmm.Aligner(p)
    assert of("GTACGTAC") == "..GTACGT--AC.."


def test_band_holds_the_path():
    p = hmm.build(hmm.count_alignment(["".join(np.random.default_rng(0).choice(list("ACGT"), 60))] * 10), dirichlet.Prior.flat())
    read = np.array([p.em[1:].argmax(1)])
    low, high = hmm.band([(11, 30, 11, 30)], 60, p.size)
    assert np.isclose(hmm.Aligner(p).align(read)[0][0], hmm.Aligner(p).align(read, low, high)[0][0])


def test_padding_and_mates():
    assert hmm.justified("abcd", 6) == "ab--cd" and hmm.justified("abc", 6) == "ab---c" and hmm.justified("abcdef", 4) == "abef"
    a = hmm.Alignment(1, 3, 1, 3, 1, 3, 2.0, "ACG...")
    b = hmm.Alignment(1, 2, 5, 6, 5, 6, 1.0, "....TT")
    m = hmm.merge_mates(a, b)
    assert m.alignment == "ACG-TT" and (m.cs_start, m.cs_end, m.cost) == (1, 6, 3.0)


def test_dirichlet_training_and_text():
    rng = np.random.default_rng(0)
    f = np.array([rng.multinomial(40, rng.dirichlet([2, 1, 5, 0.5])) for _ in range(400)])
    m = dirichlet.train(f)
    assert m.cost <= -dirichlet.Mixture.density([2, 1, 5, 0.5]).loglik(f) and np.allclose(m.alpha, [[2, 1, 5, 0.5]], rtol=0.4)
    two = dirichlet.train_best(f, 2, 2)
    assert two.cost <= m.cost + 5 and np.isclose(two.q.sum(), 1)
    step, alpha, w = 1e-6, np.array([2.0, 1.0, 5.0, 0.5]), np.ones(len(f))
    slope = [(dirichlet._count_loglik(f, alpha * np.exp(step * e)).sum() - dirichlet._count_loglik(f, alpha).sum()) / step for e in np.eye(4)]
    assert np.allclose(dirichlet._gradient(f, alpha, w), slope, rtol=1e-3, atol=0.05)
    prior = dirichlet.Prior(two, m, dirichlet.Mixture.density([7, 1, 1]), dirichlet.Mixture.density([1, 2]), dirichlet.Mixture.density([2, 1]))
    again = dirichlet.Prior.read(prior.write())
    assert np.allclose(again.match.alpha, two.alpha) and np.allclose(again.from_match.alpha, [[7, 1, 1]]) and np.isclose(again.match.cost, two.cost)
    assert np.isclose(two.posterior_mean(np.array([3.0, 0, 1, 0])).sum(), 1)
