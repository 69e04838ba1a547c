"""Patterns of any length against a plain search."""

import random

import pytest


def plain(seqs, patterns):
    return sorted((p, k, i + 1) for p in set(patterns) if p for k, s in seqs for i in range(len(s)) if s.startswith(p, i))


@pytest.mark.parametrize("width,block", [(3, 1 << 18), (8, 5), (32, 1 << 18)])
def test_patterns(spark, width, block, monkeypatch):
    from reedbank.operators import suffix

    monkeypatch.setattr(suffix, "BLOCK_PATTERNS", block)
    rng = random.Random(width)
    # one stretch is in a third of all rows, some rows are empty or very short
    seqs = [(k, "".join(rng.choices("ACGT", k=rng.choice([0, 1, 2, 30, 60])))) for k in range(40)] + [(100 + k, "ACGTACGTAC" * 3) for k in range(20)]
    patterns = ["A", "C", "G", "T", "AC", "TTTTTTTTTT", "", "ACGTACGTAC" * 3, "ACGTACGTAC" * 4, "CG"]
    patterns += [s[i : i + n] for _, s in seqs for i, n in ((rng.randrange(30), rng.randrange(1, 41)),) if len(s) > i]
    rows = spark.createDataFrame(seqs, "id int, seq string").repartition(5)
    asked = spark.createDataFrame([(p,) for p in patterns + patterns[:5]], "pattern string")
    order = suffix.order(rows, width)
    want = plain(seqs, patterns)
    places = suffix.locate(order, asked, rows, width)
    assert sorted(tuple(r) for r in places.collect()) == want
    n = {p: sum(w[0] == p for w in want) for p, _, _ in want}
    assert {r.pattern: r.n for r in suffix.count(order, asked, rows, width).collect()} == n
    first = {}
    for p, k, i in want:
        first.setdefault(p, (k, i))
    assert {r.pattern: (r.id, r.offset) for r in suffix.first(places).collect()} == first
    assert {r.pattern: r.n_rows for r in suffix.rows_with(places).collect()} == {p: len({k for q, k, _ in want if q == p}) for p in n}


def test_nothing(spark):
    from reedbank.operators import suffix

    rows, none = spark.createDataFrame([(1, "ACGT")], "id int, seq string"), spark.createDataFrame([], "pattern string")
    assert suffix.count(suffix.order(rows), none, rows).count() == 0
    assert suffix.locate(suffix.order(rows.where("id > 1")), spark.createDataFrame([("A",)], "pattern string"), rows).count() == 0


def test_order_is_sorted_and_whole(spark):
    from reedbank.operators import suffix

    rng = random.Random(0)
    seqs = [(k, "".join(rng.choices("AC", k=20))) for k in range(50)]
    parts = suffix.order(spark.createDataFrame(seqs, "id int, seq string"), 6).rdd.glom().collect()
    flat = [(r.letters, r.id, r.offset) for p in parts for r in p]
    assert flat == sorted((s[i : i + 6], k, i + 1) for k, s in seqs for i in range(20))


@pytest.fixture(scope="module")
def many(spark):
    """Rows with repeats, gaps and one stretch that many share; more patterns than a block has rows."""
    rng = random.Random(7)
    aligned = [(k, "".join(rng.choices("ACGT-", k=rng.choice([0, 1, 3, 40, 70])))) for k in range(60)] + [(100 + k, "AC-GT" * 8) for k in range(30)]
    aligned += aligned[-3:]
    seqs = [(k, a.replace("-", ""), [i + 1 for i, c in enumerate(a) if c != "-"]) for k, a in aligned]
    patterns = sorted({s[i : i + n] for _, s, _ in seqs for i in range(0, len(s), 3) for n in (1, 2, 3, 4, 5, 9, 20) if s[i : i + n]} | {"ACGT" * 20, "TTTTTTT"})
    want = sorted((p, k, i + 1, c) for p in patterns for k, s, c in seqs for i in range(len(s)) if s.startswith(p, i))
    return spark.createDataFrame(aligned, "id int, aln string").repartition(3), spark.createDataFrame([(p,) for p in patterns], "pattern string"), want


@pytest.mark.parametrize("block", [3, 1 << 18])
def test_one_pass_for_any_number_of_patterns(spark, many, block, monkeypatch):
    """Formerly a pass over all suffixes for each block of patterns, whose patterns went through the driver."""
    from reedbank.operators import suffix

    aligned, asked, want = many
    monkeypatch.setattr(suffix, "BLOCK_PATTERNS", block)
    passes, over = [], suffix.Search.over
    monkeypatch.setattr(suffix.Search, "over", lambda self, which, *a: passes.append(which) or over(self, which, *a))
    rows = suffix.ungapped(aligned)
    of = suffix.places(rows, 4), asked, rows, 4
    first, where, n = {}, sorted((p, k, c[i - 1], c[i + len(p) - 2]) for p, k, i, c in want), {}
    for p, k, i, _ in want:
        first.setdefault(p, (k, i))
        n.setdefault(p, []).append(k)
    assert {r.pattern: r.n for r in suffix.count(*of).collect()} == {p: len(k) for p, k in n.items()}
    assert passes == [suffix.SHORT, suffix.LONG]
    assert sorted(map(tuple, suffix.locate_columns(*of).collect())) == where
    assert {r.pattern: (r.id, r.offset) for r in suffix.locate_first(*of).collect()} == first
    assert {r.pattern: r.n_rows for r in suffix.count_rows(rows, asked, 4).collect()} == {p: len(set(k)) for p, k in n.items()}


def test_places_meet_rows_before_they_are_widened(spark, many):
    """A place goes to its row once, not once for each pattern."""
    from test_growth import plan

    from reedbank.operators import suffix

    aligned, asked, _ = many
    rows = suffix.ungapped(aligned)
    text = plan(suffix.locate_columns(suffix.places(rows, 4), asked, rows, 4))
    assert text.index("Generate explode(lengths") < text.index("SortMergeJoin [id") and "Broadcast" not in text


def test_firsts_and_rows_are_summed_before_they_are_grouped(spark, many):
    from test_growth import plan

    from reedbank.operators import suffix

    aligned, asked, _ = many
    rows = suffix.ungapped(aligned)
    for found in (suffix.locate_first(suffix.places(rows, 9), asked, rows, 9), suffix.count_rows(rows, asked, 9)):
        assert "Generate explode" not in plan(found)


def test_seen(spark, monkeypatch):
    from reedbank.operators import suffix

    rows = [(1, "AAAA"), (2, "ACACAG"), (3, ""), (4, None), (5, "ACGACGTAC")]
    want = sorted((s[i : i + 10], k, i + 1, max([n for n in range(len(s) - i + 1) if n and s.find(s[i : i + n]) < i] or [0])) for k, s in rows for i in range(len(s or "")))
    for size in (1, 1 << 18):
        monkeypatch.setattr(suffix, "PLACES", size)
        assert sorted(map(tuple, suffix.places_seen(spark.createDataFrame(rows, "id int, seq string"), 10).collect())) == want
