"""Operator 11 against a plain version, and its round trip."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

ODD = [
    (None, "no key here"), (1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, " a  b "), (6, "x " * 3000), (7, "y" * 50_000), (8, "same text in two rows"), (8, "same text in two rows"), (9, "é ß 𝄞 \x1c\x85\xa0"),
    (10, "has <P> inside"), (11, "ends with <"), (12, "< S> <"), *[(k, f"word {k} <\n\nP>tail< S >") for k in range(20, 120)],
]


def plain(key, text):
    text = text or ""
    units = re.findall("[ \t-\r]*[^ \t-\r]+|[ \t-\r]+", text)
    s = hashlib.sha256(f"42:{'null' if key is None else key}".encode()).hexdigest()
    h = [int(s[i : i + 8], 16) for i in (0, 8, 16, 24)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return key, n, "plain", None, None, sha(text), sha(text)
    form = "spm" if h[3] % 100 < 80 else "psm"
    out = f"<S>{z}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{z}<M>{m}"
    return key, n, form, len(p), len(m), sha(out), sha(text)


def table(spark, rows, path):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("key", "made", "n", "form", "output")})
    df.write.parquet(f"{path}/documents.parquet")
    return str(path)


def test_rows(spark, tmp_path):
    from reedbank.llm.op11_fill_in_middle import fill_in_middle, op11_fill_in_middle, rebuild

    sf = table(spark, ODD, tmp_path)
    got = [tuple(r) for r in op11_fill_in_middle(spark, sf).collect()]
    assert sorted(got, key=str) == sorted((plain(*r) for r in ODD), key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    made = fill_in_middle(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    assert sorted(rebuild(r.output, r.form) for r in made) == sorted(t or "" for _, t in ODD)


def test_empty(spark, tmp_path):
    from reedbank.llm.op11_fill_in_middle import op11_fill_in_middle

    out = op11_fill_in_middle(spark, table(spark, [], tmp_path))
    assert out.count() == 0 and out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]


@pytest.mark.parametrize("rates", [(0, 50), (100, 0), (100, 100)])
def test_rates_and_string_keys(spark, rates):
    from reedbank.llm.op11_fill_in_middle import fill_in_middle

    df = spark.createDataFrame([(f"k{i}", f"a b c {i}") for i in range(20)], "name string, body string")
    forms = {r.form for r in fill_in_middle(df, "name", "body", 7, *rates).collect()}
    assert forms == {{(0, 50): "plain", (100, 0): "psm", (100, 100): "spm"}[rates]}
