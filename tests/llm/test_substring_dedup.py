import random
import re

import numpy as np
import pyarrow as pa

from meridia.llm import substring_dedup as S
from meridia.llm.substring_dedup import _GEAR, LEAST_GAP, MEAN_GAP, MOST, WINDOW, cuts, substring_dedup
from meridia.llm.words import chunks

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def naive_chunks(b):
    """Chunk after chunk of one text, its hash summed anew at every byte."""
    ends, before = [0], None
    for i in range(WINDOW, len(b)):
        h = sum(int(_GEAR[b[i - 1 - j]]) << j for j in range(WINDOW)) % 2**32
        if h >> 16 < 65536 // MEAN_GAP and b[i] & 0xC0 != 0x80:
            if before is None or i - before >= LEAST_GAP:
                ends.append(i)
            before = i
    for k in range(len(ends)):
        at, to = ends[k], ends[k + 1] if k + 1 < len(ends) else len(b)
        while to - (at := at + MOST) > 0:
            cut = at
            while b[cut] & 0xC0 == 0x80:
                cut -= 1
            ends.append(cut)
    ends = sorted({*ends, len(b)})
    return [b[i:j] for i, j in zip(ends, ends[1:])] if b else []


def naive_dedup(rows, min_words):
    """The rows' kept texts, by a dictionary from chunk to the least id that has it and its text."""
    texts = [(i, naive_chunks((t or "").encode())) for i, t in rows]
    owner = {}
    for i, parts in texts:
        at = 0
        for c in parts:
            if i is not None and (c not in owner or i < owner[c][0]):
                owner[c] = (i, b"".join(parts), at)
            at += len(c)
    out = []
    for i, parts in texts:
        b = b"".join(parts)
        starts = [sum(map(len, parts[:k])) for k in range(len(parts) + 1)]
        flags = [c in owner and owner[c][0] != i for c in parts]
        first = [c not in parts[:k] for k, c in enumerate(parts)]
        hit = [f and n for f, n in zip(flags, first)] + [False, False]
        runs, k = [], 0
        while k < len(parts):
            to = k
            while to < len(parts) and flags[to] == flags[k]:
                to += 1
            if flags[k]:
                s, e = starts[k], starts[to]
                for j in range(k, to):
                    if not hit[j]:
                        continue
                    _, t, p = owner[parts[j]]
                    q = starts[j]
                    before, twice = hit[j - 1] if j else False, hit[j - 2] if j > 1 else False
                    if (hit[j + 1] and not before) or (before and not twice):
                        n = 0
                        while n < min(p, q, S.REACH) and t[p - 1 - n] == b[q - 1 - n]:
                            n += 1
                        s = min(s, q - n)
                    if (before and not hit[j + 1]) or (hit[j + 1] and not hit[j + 2]):
                        p, q, n = p + len(parts[j]), q + len(parts[j]), 0
                        while n < S.REACH and p + n < len(t) and q + n < len(b) and t[p + n] == b[q + n]:
                            n += 1
                        e = max(e, q + n)
                runs.append([s, e])
            k = to
        merged = []
        for s, e in runs:
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        spots = [(m.start(), m.end()) for m in WORD.finditer(b)]
        kept, at = b"", 0
        for s, e in merged:
            if s:
                s = min([w for w, _ in spots if w >= s], default=len(b))
            if e < len(b):
                e = min([e, *(w for w, z in spots if z > e)])
            if e > s and sum(s <= w < e for w, _ in spots) >= min_words:
                kept, at = kept + b[at:s], e
        out.append((i, (kept + b[at:]).decode()))
    return sorted(out, key=str)


def longest_shared(rows):
    """For each id the most words in a row that a lesser id has too."""
    words = [(i, [m.group() for m in WORD.finditer(t.encode())]) for i, t in sorted(rows)]
    known, out = set(), {}
    for i, w in words:
        best = 0
        for s in range(len(w)):
            while s + best < len(w) and tuple(w[s : s + best + 1]) in known:
                best += 1
        out[i] = best
        known |= {tuple(w[s : s + n]) for s in range(len(w)) for n in range(1, 41) if s + n <= len(w)}
    return out


def test_runs_of_25_words_and_more_are_found(spark):
    rng = random.Random(21)
    passages = [prose(rng, rng.randint(25, 40)) for _ in range(60)] + [prose(rng, rng.randint(12, 24)) for _ in range(30)]
    rows = []
    for i in range(300):
        parts = [prose(rng, rng.randint(5, 30)) for _ in range(2)]
        if i % 2:
            parts.insert(rng.randint(0, 2), passages[rng.randrange(len(passages))])
        rows.append((i, " ".join(parts)))
    most = longest_shared(rows)
    cut = {r.doc_id for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.removed}
    due = {i for i, n in most.items() if n >= 25}
    assert len(due) > 50 and cut <= due and len(cut) >= 0.95 * len(due)


def test_agrees_with_a_plain_implementation(spark):
    rng = random.Random(11)
    pool = [prose(rng, rng.randint(5, 70)) for _ in range(12)] + ["ab" * 1500 + "é" * 800]
    rows = [(i, " ".join(rng.choice(pool) if rng.random() < 0.5 else prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(0, 4)))) for i in range(60)]
    rows += [(None, pool[0] + pool[1]), (None, pool[0] + pool[1]), (70, None), (71, ""), (5, rows[5][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for least in (1, 12, 25):
        assert sorted(((r.doc_id, r.kept_text) for r in substring_dedup(df, least).collect()), key=str) == naive_dedup(rows, least)


def test_the_shuffled_way_and_clashing_names(spark, monkeypatch):
    rng = random.Random(12)
    passage = prose(rng, 80)
    rows = [(i, prose(rng, 20) + " " + passage + " " + prose(rng, 20), "x", "y", "z") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, text_key string, id string, kept_text string")
    want = sorted(map(str, substring_dedup(df).collect()))
    monkeypatch.setattr(S, "BROADCAST_BYTES", -1)
    assert sorted(map(str, substring_dedup(df).collect())) == want


def test_patterned_chunks_are_told_apart():
    bits = [bin(i).count("1") % 2 for i in range(2048)]
    batch = pa.record_batch([pa.array(["".join("ab"[b ^ k] for b in bits) for k in (0, 1)])], names=["text"])
    (part,) = chunks(batch, "text", 1 << 30)
    c = cuts(part)
    digests = list(zip(c.a.tolist(), c.b.tolist()))
    texts = [part.bytes[i:j].tobytes() for i, j in zip(c.start, c.end)]
    assert len(set(digests)) == len(set(texts))


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_passages_go_from_all_but_the_least_id(spark):
    rng = random.Random(5)
    passages = [prose(rng, rng.randint(51, 90)) for _ in range(40)]
    phrases = [prose(rng, 12) for _ in range(10)]
    rows, holds = [], {}
    for i in range(400):
        parts = [prose(rng, rng.randint(5, 80)) for _ in range(3)]
        if i % 2:
            parts.insert(rng.randint(0, 3), phrases[i % 10])  # recurs, but is short
        if i % 4 == 0:
            k = rng.randrange(40)
            parts.insert(rng.randint(0, 3), passages[k])
            holds.setdefault(k, []).append(i)
        rows.append((i, rng.choice([" ", "\n"]).join(parts), "x"))
    got = {r.doc_id: r for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string, gone string")).collect()}
    late = {i for v in holds.values() for i in v[1:]}
    cut = {i for i, r in got.items() if r.removed}
    assert cut <= late and len(cut) >= 0.9 * len(late)
    for i, t, _ in rows:
        b, at, kept = t.encode(), 0, b""
        for s in got[i].removed:
            kept, at = kept + b[at : s.start], s.end
        assert got[i].kept_text == (kept + b[at:]).decode()


def test_repeats_within_a_document(spark):
    p = prose(random.Random(9), 80)
    df = spark.createDataFrame([(1, p + "\n" + p), (2, "x\n" + p + "\ny\n" + p)], "doc_id long, text string")
    left = {r.doc_id: len(r.kept_text) for r in substring_dedup(df).collect()}
    assert left[1] == 2 * len(p) + 1 and left[2] < 0.5 * len(p)
    left = {r.doc_id: len(r.kept_text) for r in substring_dedup(df, within=True).collect()}
    assert left[1] < 1.4 * len(p)


def test_odd_rows(spark):
    long = prose(random.Random(1), 5000)
    rows = [(1, None), (2, ""), (3, long), (4, long), (None, long), (5, "é" * 20000), (6, "é" * 20000), (7, "one"), (7, "one")]
    got = [(r.doc_id, len(r.kept_text)) for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert dict(got)[1] == dict(got)[2] == dict(got)[4] == dict(got)[None] == 0
    assert dict(got)[3] == len(long) and got.count((7, 3)) == 2 and dict(got)[5] == 20000
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_cover_the_text_and_resist_shifts():
    rng = random.Random(2)
    base = prose(rng, 3000)
    batch = pa.record_batch([pa.array([base, "zz " + base, "y" * 10000])], names=["text"])
    (part,) = chunks(batch, "text", 1 << 30)
    c = cuts(part)
    assert c.start[0] == 0 and (c.start[1:] == c.end[:-1]).all() and (c.end - c.start).max() <= MOST
    own = [set(zip(c.a[i:j].tolist(), c.b[i:j].tolist())) for i, j in zip(c.first, c.first[1:])]
    assert len(own[0] & own[1]) >= 0.98 * len(own[0])
    assert 15 < np.mean((c.end - c.start)[: c.first[1]]) < 60
