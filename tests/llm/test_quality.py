import re

import numpy as np
import pyarrow as pa
import pytest

from meridia.llm import quality as Q


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op4_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(out) > 60 and np.mean([r.predicted == r.quality for r in out]) > 0.95


def test_odd_rows_and_determinism(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    m = Q.fit(docs, labels)
    again = Q.fit(docs.repartition(5), labels.repartition(3))
    assert all(np.allclose(m[k], again[k]) for k in m)
    df = spark.createDataFrame([(1, None), (2, ""), (3, "Good text " * 30000), (None, "x"), (4, "x")], "doc_id long, text string")
    got = {r.doc_id: r.score for r in Q.score(df, m).collect()}
    assert got[1] == got[2] and got[None] == got[4] and all(0 <= s <= 1 for s in got.values())
    assert Q.score(df.limit(0), m).count() == 0
    assert Q.fit(docs, labels.limit(0))["W"].shape == (Q.WIDTH, 24)


def naive_score(m, text):
    """One document by the definition, passage after passage."""
    raw = (text or "").encode()
    es, hs = [], []
    for k in range(0, max(len(raw), 1), Q.PASSAGE):
        part = raw[k : k + Q.PASSAGE]
        x = np.zeros(Q.WIDTH)
        before = 4
        for byte in part:
            x[before * Q.KINDS + Q.KIND[byte]] += 1 / len(part)
            before = Q.KIND[byte]
        x = np.sqrt(x)
        words = [w for w in re.split(rb"[^0-9a-z\x80-\xff]+", part.lower()) if w]
        if words:
            for i, lag in enumerate(Q.LAGS):
                x[Q.KINDS**2 + i] = sum(a == b for a, b in zip(words, words[lag:])) / len(words)
            x[-3], x[-2] = len(set(words)) / len(words), sum(map(len, words)) / len(words) / 10
        x[-1] = np.log1p(len(part)) / 6
        h = np.tanh(x @ m["W"] + m["b"])
        hs.append(h)
        es.append((np.tanh(h @ m["V"]) / (1 + np.exp(-(h @ m["U"])))) @ m["w"])
    a = np.exp(es) / np.exp(es).sum()
    return 1 / (1 + np.exp(-(a @ np.array(hs) @ m["c"] + m["d"])))


def test_scores_by_the_definition(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    m = Q.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    rows = docs.limit(60).collect()
    for span in (Q.SPAN, 3):  # long documents some passages at a time
        monkeypatch.setattr(Q, "SPAN", span)
        batch = pa.record_batch([pa.array([r.text for r in rows] + [None, ""])], names=["text"])
        (got,) = Q._scores([batch], type("B", (), {"value": m}), "text", "score") if sum(len(r.text.encode()) for r in rows) < 1 << 20 else pytest.skip("more than one part")
        assert np.allclose(got.column(1).to_pylist(), [naive_score(m, t) for t in [*(r.text for r in rows), None, ""]], atol=1e-4)


def test_the_driver_gets_a_bounded_sample(spark):
    docs = spark.createDataFrame([(i, f"Good text number {i}. " * 20000) for i in range(20)], "doc_id long, text string")
    (batch,) = docs.limit(3).selectExpr("text", "1.0D AS label").toArrow().combine_chunks().to_batches()
    for b in Q._bags([batch], 16):
        assert all(len(x.as_py()) == 16 * Q.WIDTH * 4 for x in b.column(0))
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id long, quality int")
    assert Q.fit(docs, labels)["W"].shape == (Q.WIDTH, 24)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    x, first, y = rng.normal(size=(9, Q.WIDTH)), np.array([0, 2, 3, 9]), np.array([1.0, 0.0, 1.0])
    m = Q.train([x[:2]], np.array([1.0]), width=4, epochs=1)
    loss = lambda: -(y * np.log(p := Q.forward(m, x, first)["p"]) + (1 - y) * np.log(1 - p)).mean()
    g = Q.gradients(m, x, first, y)
    for k in ("W", "V", "U", "w", "c"):
        at = (0,) * m[k].ndim
        was = m[k][at]
        m[k][at] = was + 1e-5
        up = loss()
        m[k][at] = was - 1e-5
        down = loss()
        m[k][at] = was
        assert abs((up - down) / 2e-5 - g[k][at]) < 1e-6
