from collections import Counter, defaultdict
from itertools import combinations
import re

import numpy as np
import pyarrow as pa

from meridia.llm.near_dedup import ID_BITS, bag_min_hash, near_classes, stage_near_dedup
from meridia.llm.words import chunks, sequence_digests, words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(text):
    w = WORD.findall((text or "").translate(LOW))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def brute(rows, threshold=0.8):
    """Least id of each row's component, every pair that shares a gram compared."""
    bags = {i: bag(t) for i, t in rows}
    root = {i: i for i in bags}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(set)
    for i, b in bags.items():
        for g in b or [None]:
            by[g].add(i)
    for x, y in {p for s in by.values() for p in combinations(sorted(s), 2)}:
        a, b = bags[x], bags[y]
        both = sum((a & b).values())
        if not a and not b or both >= threshold * sum((a | b).values()):
            x, y = sorted((find(x), find(y)))
            root[y] = x
    return {i: find(i) for i in bags}


def test_agrees_with_every_pair_compared(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = brute(rows)
    got = {r.doc_id: r for r in near_classes(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == want
    size = Counter(want.values())
    assert all(r.class_size == size[r.class_id] and r.kept == (r.class_id == i) for i, r in got.items())


def test_odd_rows(spark):
    long = " ".join(f"w{i}" for i in range(300))
    chain = [" ".join(f"x{i}" for i in range(k, k + 100)) for k in range(0, 60, 6)]  # neighbours are near, the ends are not
    rows = [(1, None), (2, ""), (3, "..."), (4, "One two"), (5, "one, TWO"), (6, "one"), (7, long), (8, long + " w300"), (9, "a b c d e " * 50), (10, "a b c d e " * 100), (11, long), (11, long), (None, long)]
    rows += [(20 + i, t) for i, t in enumerate(chain)]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, bands string")
    got = {r.doc_id: r.class_id for r in near_classes(df).collect()}
    assert [got[i] for i in (1, 2, 3)] == [1, 1, 1] and got[4] == got[5] == 4 and got[6] == 6
    assert got[7] == got[8] == got[11] == got[None] == 7
    assert got[9] == 9 and got[10] == 10  # the same set of grams, but half the counts
    assert {got[20 + i] for i in range(10)} == {20}
    assert near_classes(df.limit(0)).count() == 0


def test_null_ids_are_told_apart_by_their_texts(spark):
    texts = [" ".join(f"{c}{i}" for i in range(200)) for c in "xyz"]
    got = near_classes(spark.createDataFrame([(None, texts[0]), (None, texts[1]), (None, texts[2]), (5, texts[0] + " more")], "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == [(5, 5, 2, True), (None, 5, 2, False), (None, None, 1, True), (None, None, 1, True)]

    # Against brute force: the same rows with and without ids have the same classes.
    rows = [(i, r.text) for i, r in enumerate(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect())]
    want = brute(rows)
    size = Counter(want.values())
    some = spark.createDataFrame([(i if i % 3 else None, t) for i, t in rows], "doc_id long, text string")
    assert Counter(r.class_size for r in near_classes(some).collect()) == Counter(size[c] for c in want.values())
    docs = some.selectExpr("*", "'x' AS near_key")
    kept = stage_near_dedup(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(size)
    assert stage_near_dedup(spark, docs.unionByName(docs), "").count() == len(size)


def test_digests_tell_patterned_texts_apart():
    bits = [bin(i).count("1") % 2 for i in range(2048)]  # sums of powers modulo 2**64 are equal for these
    pair = ["".join("ab"[b ^ k] for b in bits) for k in (0, 1)] + [" ".join(["aa", "bb"][b ^ k] for b in bits) for k in (0, 1)]
    (part,) = chunks(pa.record_batch([pa.array(pair)], names=["t"]), "t")
    w = words(part)
    assert w.hash[0] != w.hash[1]
    a, b = sequence_digests(w)
    assert a[2] != a[3] and b[2] != b[3]


def test_signatures_estimate_the_weighted_jaccard_similarity():
    rng = np.random.default_rng(1)
    hits = []
    for _ in range(60):
        grams = rng.integers(0, 1 << 40, 40).astype(np.uint64)
        a, b = rng.integers(1, 12, 40), rng.integers(1, 12, 40)
        regs = bag_min_hash(np.repeat([0, 1], 40), np.concatenate((grams, grams)), np.concatenate((a, b)), 2)
        hits.append(((regs[0] & ID_BITS) == (regs[1] & ID_BITS)).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(hits)) < 0.02
