"""The corpus pipeline against plain versions of its stages."""

import re
import zlib

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F
from reedbank.llm import op07_quality_knn as quality

SF = "/root/testdata/sf0.001"


def plain_good(docs, labels):
    """Keys of texts that the nearest of all labelled texts vote for: dense vectors, a full sort for each text."""

    def sparse(t):
        raw = np.frombuffer((t or "").encode(), np.uint8)
        return quality.block_features(raw, np.array([0, len(raw)]))[1:]

    model = quality.fit([(*sparse(docs[k]), float(y)) for k, y in labels.items() if k in docs])
    good = set()
    for k, t in docs.items():
        column, value = sparse(t)
        if not len(column):
            continue
        dense = np.zeros(quality.WIDTH)
        dense[column] = quality.weigh(np.zeros(len(column), np.int64), column, value, model["idf"], 1)
        point = dense @ model["directions"].astype(np.float64)
        cosine = model["vectors"].astype(np.float64) @ (point / np.linalg.norm(point))
        near = sorted(range(len(cosine)), key=lambda i: -cosine[i])[: quality.NEIGHBOURS]
        weight = [max(cosine[i], 1e-3) ** quality.SHARPNESS for i in near]
        if sum(w * model["labels"][i] for w, i in zip(weight, near, strict=True)) / sum(weight) >= quality.THRESHOLD:
            good.add(k)
    return good


def test_pipeline(spark):
    import test_ops as plain
    from tokenizers import Tokenizer

    import public_tokenizers

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 and r.quality is not None:
            labels[r.doc_id] = min(labels.get(r.doc_id, 9), r.quality)
    good = plain_good(docs, labels)
    rows = [(k, t) for k, t in sorted(docs.items()) if k in good]
    rows = [(k, docs[k]) for k, _, c in plain.jaccard(rows) if k == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {k for k, _, n, _ in plain.contamination(rows, items) if not n}
    want = {}
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for k, text in rows:
        if k in clean:
            out, at = "", 0
            for a, _, kind, z in plain.secrets(text):
                if a >= at:
                    out += text[at:a] + f"[{kind}]"
                at = max(at, z)
            want[k] = t.encode(out + text[at:], add_special_tokens=False).ids
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want and 0 < len(got) < len(docs)


def test_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
    assert re.search("BPE", corpus_pipeline.STAGES[-1][0])


def test_stages_on_odd_rows(spark):
    """Nulls, repeated rows, equal ids with other texts or columns, empty tables and clashing columns."""
    from test_ops import ODD, frame

    rows = [*ODD, (None, None), (20, "word " * 40), (20, "other words here " * 9), (21, None), (21, None)]
    clashing = {c: F.lit(c) for c in ("__key", "__score", "__blob", "score", "mark", "row")}
    for df in (frame(spark, rows), frame(spark, []), frame(spark, rows).withColumns(clashing)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, df, SF)
            got = [tuple(r) for r in out.collect()]
            if name.startswith("BPE"):
                assert len(got) == df.count()
            elif name != "secret scans":
                assert out.columns == df.columns and set(got) <= {tuple(r) for r in df.collect()}, name
                assert "Jaccard" not in name or len(got) == len(set(got)) == len({(r[0], r[1]) for r in got})
            else:
                assert len(got) == df.count() and out.columns == df.columns
