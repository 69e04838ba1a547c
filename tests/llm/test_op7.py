import numpy as np

from reedbank.llm import op07_quality_knn as quality


def test_features_come_to_the_driver_as_bytes(spark, monkeypatch):
    """Lists of Python's numbers take twenty times as much of the driver's memory."""
    seen = []
    monkeypatch.setattr(quality, "fit", lambda rows: seen.extend(rows))
    documents = spark.createDataFrame([(i, f"some words, {i} of them. some words, again") for i in range(1, 9)] + [(9, "")], "doc_id long, text string")
    quality.train(documents, spark.createDataFrame([(i, i % 2) for i in range(1, 10)], "doc_id long, quality int"))
    assert seen and all(isinstance(x.base, bytes) for c, v, _ in seen for x in (c, v))
    assert {(c.dtype, v.dtype) for c, v, _ in seen} == {(np.dtype(np.int32), np.dtype(np.float32))}
    assert all(len(c) == len(v) for c, v, _ in seen)
