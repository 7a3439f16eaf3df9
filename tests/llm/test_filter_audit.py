import random
import re
from itertools import permutations
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meridia.llm import filter_audit as A
from meridia.llm.filter_audit import OP13_SQL, audit, failures, op13_filter_audit
from meridia.llm.words import U64, chunks


def facts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    return len(w), len(set(w)), len(re.findall("[A-Z]", text)), len(text), len(re.findall(r"[#$%&*|]", text))


def mask(i, text, rows):
    w, d, c, p, s = facts(text)
    copy = any(t == text and j is not None and (i is None or j < i) for j, t in rows)
    return (w < 200) + 2 * (100 * d < 50 * w) + 4 * (100 * c > 3 * p) + 8 * (s > 0) + 16 * copy


def brute(rows, labels):
    """Every document through every order, one after the other."""
    texts = [(i, t or "") for i, t, _ in rows]
    docs = [(part or "", mask(i, t or "", texts), *labels.get(i, (0, 0))) for i, t, part in rows]
    out, sums = {}, {}
    for order in permutations("ABCDE"):
        alive = list(range(len(docs)))
        for step, f in enumerate(order, 1):
            bit = 1 << "ABCDE".index(f)
            gone = {k for k in alive if docs[k][1] & bit}
            left = [k for k in alive if k not in gone]
            for part in {d[0] for d in docs}:
                own = [k for k in range(len(docs)) if docs[k][0] == part]
                here = [k for k in gone if docs[k][0] == part]
                fails = [k for k in own if docs[k][1] & bit]
                out[part, "".join(order), step] = [sum(docs[k][0] == part for k in left), len(here), sum(k not in alive for k in fails), sum(docs[k][1] == bit for k in own), sum(docs[k][2] == 1 for k in here), sum(docs[k][3] == 1 for k in here)]
                sums[part, f] = sums.get((part, f), 0) + len(here)
            alive = left
    return sorted((*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def texts(n, seed):
    rng = random.Random(seed)
    words = ["der", "Éclair", "BIG", "x", "数学", "a#b", "50%", "naïve", "stop.", "Stop.", "tail end", " "]
    out = []
    for _ in range(n):
        pool = rng.sample(words, rng.randint(1, 6)) + [str(k) for k in range(rng.choice([0, 0, 400]))]
        out.append("".join(rng.choice(pool) + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for _ in range(rng.choice([0, 3, 199, 200, 240]))))
    return out


def test_facts_of_a_text(spark, monkeypatch):
    monkeypatch.setattr(A, "SPAN", 37)  # pieces end inside words and documents
    rows = list(enumerate(texts(60, 1))) + [(100, "x"), (101, ""), (102, "A" * 500 + " b"), (103, " "), (104, "ab"), (105, "cd")]
    batch = pa.record_batch([pa.array([t for _, t in rows])], names=["text"])
    for limit in (1, 1 << 20):
        got = []
        for part in chunks(batch, "text", limit):
            start, end, points, capitals, symbols = A.run(part)
            n = np.diff(np.searchsorted(start, part.bounds))
            got += list(zip(n.tolist(), A.distinct_words(part, start, end).tolist(), capitals.tolist(), points.tolist(), symbols.tolist(), strict=True))
        assert got == [facts(t) for _, t in rows]


def test_words_of_one_hash_are_told_apart():
    batch = pa.record_batch([pa.array(["aa bb aa cc a bb", "", "a a", "long longer long"])], names=["text"])
    (part,) = chunks(batch, "text")
    start, end, *_ = A.run(part)
    assert A.distinct_words(part, start, end, lambda raw, s, e: np.zeros(len(s), U64)).tolist() == [4, 0, 1, 2]


def test_every_order(spark):
    rng = random.Random(2)
    pool = texts(40, 3)
    rows = [(i, rng.choice(pool), rng.choice(["en", "de"])) for i in range(90)]
    rows += [(200, None, "en"), (201, "", None), (202, None, ""), (None, pool[0], "en"), (None, "only here", "en"), (None, "only here", "de"), (203, "w " * 90_000, "fr"), (7, rows[7][1], "en"), (204, pool[1] * 3, None)]
    labels = {i: (rng.randint(0, 1), rng.randint(0, 1)) for i in range(0, 90, 2)}
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, n int, failed string")
    lab = spark.createDataFrame([(i, *v) for i, v in labels.items()] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    got = sorted(map(tuple, audit(df, lab).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()))
    assert got == brute(rows, labels)
    assert audit(df.limit(0), lab).count() == 0 and audit(df, lab.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def test_the_shuffled_way_gives_the_same(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = sorted(map(tuple, failures(docs).collect()))
    monkeypatch.setattr(A, "BROADCAST_ROWS", -1)
    assert sorted(map(tuple, failures(docs).collect())) == want


def test_sql_on_the_small_tables(spark, sf):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{Path(sf) / t}.parquet')")
    want = con.execute(OP13_SQL)
    names = [d[0] for d in want.description]
    df = op13_filter_audit(spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.fetchall())
