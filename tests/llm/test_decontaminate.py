import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meridia.llm import decontaminate as D
from meridia.llm import words as W

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
split = lambda t: WORD.findall((t or "").translate(LOW))


def brute(docs, items, window):
    wins = {}
    for i, t in items:
        w = split(t)
        k = min(window, len(w))
        for p in range(len(w) - k + 1 if w else 0):
            wins.setdefault(tuple(w[p : p + k]), set()).add(i)
    out = {}
    for d, t in docs:
        w, hit, found = split(t), set(), set()
        for k in {len(x) for x in wins}:
            for p in range(len(w) - k + 1):
                if got := wins.get(tuple(w[p : p + k])):
                    hit |= set(range(p, p + k))
                    found |= got
        out[d] = (len(w), len(hit), sorted(found))
    return out


def check(spark, docs, items, window=5):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = D.find_contamination(d, b, window).withColumn("n_hit", D.count_hits()).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, sorted(r.items)) for r in got} == brute(docs, items, window)
    assert all(len(r.items) == len(set(r.items)) for r in got)
    told = [tuple(r) for r in D.match_locations(d, b, window).collect()]
    assert len(told) == len(set(told)) and sorted(told) == sorted(stretches(docs, items, window))
    best = {r.item: r.n_words for r in D.longest_matches(d, b, window=window).collect()}
    assert best == {i: max(n for _, j, _, _, n in told if j == i) for i in {x[1] for x in told}}


def stretches(docs, items, window):
    """Every maximal common run of a window or more, by comparing every place of a document with every place of an item."""
    for d, t in docs:
        w = split(t)
        for i, u in items:
            v = split(u)
            at = {}
            for q, x in enumerate(v):
                at.setdefault(x, []).append(q)
            for p in range(len(w)):
                for q in at.get(w[p], ()):
                    if p and q and w[p - 1] == v[q - 1]:
                        continue
                    n = 0
                    while p + n < len(w) and q + n < len(v) and w[p + n] == v[q + n]:
                        n += 1
                    if n >= min(window, len(v)):
                        yield d, i, q, p, n


def test_against_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocab = ["a", "b", "C", "dé", "e1"]
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(vocab) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 14)))) for i in range(12)] + [(90, None), (91, "..."), (92, "zz top"), (93, "zz top")]
    docs += [(200, None), (201, ""), (202, "zz TOP; zz top zz"), (203, "a " * 5000), (204, "zz"), (205, "top")]
    check(spark, docs, items)
    monkeypatch.setattr(D, "BLOCK_BYTES", 300)  # several blocks
    check(spark, docs, items)
    part = pa.record_batch([pa.array([d for d, _ in docs]), pa.array([t for _, t in docs])], names=["doc_id", "text"])
    items = pa.array([t for _, t in items if t]), pa.array([[i] for i, t in items if t])
    whole = found_in(part, items)
    monkeypatch.setattr(D, "SHARD_WORDS", 37)  # arrays that end within documents
    monkeypatch.setattr(W, "SPAN", 50)
    assert found_in(part, items) == whole and any(x[2] for x in whole[0])


def found_in(part, items):
    """Both results of one task, with the items as one block."""
    blocks = D.Blocks("", [""], 5)
    blocks.kept = "", D.Items(*items, 5)
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.int64()))])
    rows = [tuple(r.values()) for b in D._found([part], blocks, "text", ["doc_id"], out) for r in b.to_pylist()]
    places = pa.schema([("doc_id", pa.int64()), ("item", pa.int64()), ("p", pa.int32()), ("q", pa.int32()), ("n", pa.int32())])
    return rows, sorted(tuple(r.values()) for b in D._stretches([part], blocks, "text", "doc_id", places) for r in b.to_pylist())


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(0)
    w = rng.integers(0, 3, 500).astype(np.uint64)
    order = D.suffix_array(w, 600).tolist()
    assert order == sorted(range(500), key=lambda i: w[i:].tolist())


def test_stage_and_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = D.stage_decontamination(spark, docs, sf)
    assert kept.columns == docs.columns and D.find_contamination(kept, spark.read.parquet(f"{sf}/benchmark.parquet")).where(F.size("items") > 0).count() == 0
    assert D.stage_decontamination(spark, docs.limit(0), sf).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_contamination(docs, none).where(F.size("hit_spans") > 0).count() == 0


def test_many_equal_items_and_a_common_word(spark):
    items = [(i, "yes") for i in range(10000)] + [(20000 + i, f"yes no {i % 3}") for i in range(300)]
    docs = [(i, "yes " * 3000) for i in range(20)] + [(50, "no"), (51, "Yes, no! 2")]
    got = {r.doc_id: r for r in D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(sorted(got[i].items) == list(range(10000)) and got[i].hit_spans == [(0, 3000)] for i in range(20))
    assert not got[50].items and len(got[51].items) == 10100 and got[51].hit_spans == [(0, 3)]
    assert D.find_contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("a", "NO"), ("b", "no")], "item_id string, text string")).where("array_size(items) = 2").count() == 2
