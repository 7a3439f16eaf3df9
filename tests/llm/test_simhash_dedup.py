import random
import re

import numpy as np
import pytest
import xxhash

from meridia.llm import simhash_dedup as S
from meridia.llm.simhash_dedup import group_links, near_fingerprints, op12_simhash, simhash_classes, within_radius

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(len(w) - 2, 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def partition(fps, radius=2):
    """Least place of each place's component, every pair compared."""
    of = list(range(len(fps)))

    def root(i):
        while of[i] != i:
            i = of[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = sorted((root(i), root(j)))
                of[b] = a
    return [root(i) for i in range(len(fps))]


def expected(rows):
    fps = [fingerprint(t) for _, t in rows]
    part = partition(fps)
    least = {c: min((r[0] for r, p in zip(rows, part, strict=True) if p == c and r[0] is not None), default=None) for c in set(part)}
    return sorted(((r[0], f"{f:016x}", least[p]) for r, f, p in zip(rows, fps, part, strict=True)), key=repr)


def test_documents_against_every_pair(spark):
    rng = random.Random(5)
    words = "Alpha beta GAMMA delta épsilon zeta 数学 theta".split()
    rows = [(i, rng.choice([" ", "\n", "\t \x0b"]).join(rng.choice(words) for _ in range(rng.randint(0, 6)))) for i in range(150)]
    long = [rng.choice(words) + str(rng.randint(0, 400)) for _ in range(900)]
    rows += [(1000 + i, " ".join(long[:400] + [f"new{i}"] + long[401:])) for i in range(40)]
    rows += [(None, "alpha beta gamma"), (7, "ALPHA  beta\ngamma"), (7, "ALPHA  beta\ngamma"), (2000, None), (2001, ""), (2002, " \t"), (2003, "x" * 300_000), (2004, "one two " * 60_000), (None, "quite alone here")]
    df = spark.createDataFrame([(*r, "a", 5) for r in rows], "doc_id long, text string, fp string, component_id int")
    assert sorted(map(tuple, simhash_classes(df).collect()), key=repr) == expected(rows)
    assert simhash_classes(df.limit(0)).count() == 0


@pytest.mark.parametrize("group", [4096, 3])
def test_components_of_close_fingerprints(spark, monkeypatch, group):
    """Chains of one and two flips around few centres: large buckets, some dealt twice."""
    monkeypatch.setattr(S, "GROUP", group)
    rng = random.Random(6)
    found = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            found.add(x)
            for _ in range(rng.choice([1, 2, 2, 3])):
                x ^= 1 << rng.randrange(64)
    fps = sorted(found)
    signed = [f - (1 << 64) * (f >> 63) for f in fps]
    for radius in (0, 1, 2):
        edges = near_fingerprints(spark.createDataFrame([(f,) for f in signed], "fp long"), radius).collect()
        assert all((e.src ^ e.dst) & (1 << 64) - 1 for e in edges)
        at = {f: i for i, f in enumerate(signed)}
        of = list(range(len(fps)))
        for _ in range(len(fps)):
            for e in edges:
                a, b = at[e.src], at[e.dst]
                of[a] = of[b] = min(of[a], of[b])
        assert of == partition(fps, radius)


def test_bit_slices_count_like_popcount():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**63, 5, dtype=np.uint64)
    fps = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)) for b in base]))
    for radius in (0, 1, 2):
        want = np.array([[(int(a) ^ int(b)).bit_count() <= radius for b in fps] for a in fps[:70]])
        got = within_radius(fps[:70], S.planes(fps), radius)[:, : len(fps)]
        assert (got == want).all()


def test_a_group_larger_than_a_block(monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 128)
    monkeypatch.setattr(S, "QUERIES", 50)
    rng = random.Random(9)
    fps = list({rng.getrandbits(12) for _ in range(700)})
    a, b = group_links(np.array(fps, np.uint64))
    assert len(a) == len(fps) - len(set(partition(fps)))  # a link a fingerprint, not all pairs


def test_a_registered_run(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, op12_simhash(spark, sf).collect()), key=repr) == expected(rows)
