"""Operator 13: folding, matching against a plain search, learning from made labels, held-out accuracy."""

import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.1"


def test_fold():
    from reedbank.llm.op13_toxicity import fold

    same = ["idiot", "1d10t", "IDI0T", "іdіоt", "i​d­iot", "ｉｄｉｏｔ", "ldlot", "idi̸ot"]
    assert {fold(x)[0] for x in same} == {"idiot"}
    assert fold("a  $cum \t\n in 2024, 5 @ 7") == ("a scum in ,", 4)
    assert fold(None) == fold("") == fold("  \n") == ("", 0)
    assert fold("été trébuchet")[0] == "été trébuchet"


def test_matcher():
    from reedbank.llm.op13_toxicity import Matcher, fold

    m = Matcher({"trash": 2.0, "scum": 3.0, "idiot": 4.0}, ["trash can", "the idiot proof lock".replace("l", "i")])
    hit = lambda x: [w for w, _ in m.density(*fold(x))[1]]
    assert hit("Trash, trashy scum_ SCUM? (1d1ot)") == ["trash", "scum", "scum", "idiot"]
    assert hit("a trash  can and trash; the idiot proof lock, idiot proof") == ["trash", "idiot"]
    assert m.without("x trash can, trash cans") == "x  , trash cans" and Matcher({}, []).without("a b") == "a b"
    assert Matcher({}, []).density("trash", 1)[0] == 0 and m.density(*fold(None)) == (0.0, [])
    assert m.density(*fold("trash " * 100))[0] == pytest.approx(200 / 101**0.5)
    # against a plain search
    rng = random.Random(0)
    for _ in range(200):
        text = fold("".join(rng.choice(["trash", "scum", " ", " can", ".", "x", "idiot", " the idiot proof iock"]) for _ in range(30)))[0]
        spared = [x.span() for p in ("trash can", "the idiot proof iock") for x in re.finditer(rf"(?<![^\W_]){p}(?![^\W_])", text)]
        found = [x for x in re.finditer(r"(?<![^\W_])(trash|scum|idiot)(?![^\W_])", text) if not any(a <= x.start() and x.end() <= b for a, b in spared)]
        assert [w for w, _ in m.hits(text)] == [x.group() for x in found]


def made(spark, n=600):
    """Toxic texts hold a bad word, in part disguised; 'bad seed' stands in clean texts only."""
    rng = random.Random(3)
    texts, labels = [], []
    for k in range(n):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.choice([5, 30, 200]))]
        toxic = k % 5 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["vile", "v1le", "VILE", "νile", "bad"])
        elif k % 7 == 0:
            words[:2] = ["bad", "seed"]
        texts.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return spark.createDataFrame(texts, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_made_labels(spark):
    from reedbank.llm import op13_toxicity as op

    docs, labels = made(spark)
    model = op.train(docs, labels)
    assert set(model["weights"]) >= {"viie", "bad"} and "bad seed" in model["exceptions"]
    got = {r.doc_id: r for r in op.score(docs, model).collect()}
    assert all((got[k].score >= op.THRESHOLD) == (k % 5 == 0) for k in got)
    odd = spark.createDataFrame([(None, "vile"), (1, None), (2, ""), (3, " \n"), (4, "vile"), (4, "vile"), (5, "x " * 100_000 + "vile"), (6, "bad seed")], "doc_id bigint, text string")
    odd = odd.withColumns({c: F.lit(c) for c in ("key", "score", "term", "label", "half", "n_hits")})
    out = {(r.doc_id, r.score, r.n_hits) for r in op.score(odd, model).collect()}
    none = op.score(odd.where("doc_id = 2"), model).first().score
    assert {(k, s) for k, s, n in out if n == 0} == {(1, none), (2, none), (3, none), (6, none)} and len(out) == 7
    high, long = next(s for k, s, _ in out if k == 4), next(s for k, s, _ in out if k == 5)
    assert next(s for k, s, _ in out if k is None) == high > op.THRESHOLD > long > none
    # a bound on the sample, given phrases, and no order of rows
    again = op.train(docs.repartition(7), labels.unionByName(labels).repartition(3), exceptions=("so  VILE!",))
    assert again["weights"] == model["weights"] and again["exceptions"] == sorted({*model["exceptions"], "so viie!"})
    assert op.train(docs, labels, sample=0) == {"empty": True}


def test_learns_nothing_from_held_out(spark):
    from reedbank.llm import op13_toxicity as op

    docs, labels = made(spark, 200)
    held = F.udf(lambda k: zlib.crc32(str(k).encode()) % 3 == 1, "boolean")("doc_id")
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert op.train(docs, labels) == op.train(docs, turned)


def test_empty(spark):
    from reedbank.llm import op13_toxicity as op

    docs, labels = made(spark, 20)
    for d, lab in ((docs, labels.limit(0)), (docs.limit(0), labels), (docs, labels.withColumn("toxic", F.lit(None).cast("int"))), (docs, labels.where("toxic = 0"))):
        model = op.train(d, lab)
        assert model == {"empty": True} and all(r.score == 0 for r in op.score(docs, model).collect())
    assert op.score(docs.limit(0), op.train(*made(spark, 100))).count() == 0


def test_held_out_accuracy(spark):
    from reedbank.llm.op13_toxicity import op13_toxicity

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = op13_toxicity(spark, SF).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").collect()
    bad, good = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert len(bad) > 100 and sum(r.predicted for r in bad) >= 0.9 * len(bad)
    assert sum(r.predicted for r in good) <= 0.005 * len(good)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
