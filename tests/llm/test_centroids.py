import hashlib
import random
from pathlib import Path

import duckdb
import numpy as np
import pytest

from meridia.llm import centroids as C
from meridia.llm.centroids import OP11_SQL, cluster, op11_centroids


def brute(rows, k, rounds, dim, scale, seed):
    """Plain distances over Python numbers."""
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    cents = [v for _, v in order[:k]]
    dist = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min(range(len(cents)), key=lambda c: (dist(v, cents[c]), c))
    for _ in range(rounds):
        own = [[v for _, v in kept if near(v) == c] for c in range(len(cents))]
        cents = [[sum(col) // len(o) for col in zip(*o, strict=True)] if o else c for o, c in zip(own, cents, strict=True)]
    return sorted(((i, near(v), dist(v, cents[near(v)])) for i, v in kept), key=repr), cents


def got(found):
    df, cents = found
    return sorted(((r.vec_id, r.cluster, r.distance) for r in df.collect()), key=repr), cents


@pytest.mark.parametrize("spread", [1.0, 1e5, 1e6])  # the largest passes small()
def test_against_plain_distances(spark, spread):
    rng = random.Random(int(spread))
    rows = [(i, [spread * rng.gauss(i % 3, 0.7) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, rows[i][1]) for i in range(30)]  # repeated vectors
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(cluster(df, 5, 4, 4)) == brute(rows, 5, 4, 4, 1024, 3)


def test_ties_go_to_the_lesser_number():
    planes = C.Bisectors([[0, 0], [4, 0], [0, 4], [4, 0]])
    best, d = planes.winners(np.array([[2, 0], [2, 2], [4, 0], [0, 3], [3, 1], [100, 100]]))
    assert best.tolist() == [0, 0, 1, 2, 1, 1] and d.tolist() == [4, 8, 0, 1, 2, 100**2 + 96**2]


def test_random_ties(spark):
    rng = np.random.default_rng(4)
    cents = rng.integers(-3, 4, (8, 3)).tolist()
    x = rng.integers(-4, 5, (5000, 3))
    d = ((x[:, None, :] - np.array(cents)[None]) ** 2).sum(2)
    best, dist = C.Bisectors(cents).winners(x)
    assert (best == d.argmin(1)).all() and (dist == d.min(1)).all()


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.1, -0.1]), (2, None), (3, [1.0]), (4, [1.0, None]), (5, [nan, 0.0]), (6, [inf, 0.0]), (7, [1.0, 2.0, 3.0]), (None, [0.5, 0.5]), (1, [0.1, -0.1]), (8, [-inf, 1.0]), (9, [])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, cluster string, id int")
    found = got(cluster(df, 8, 3, 2))
    assert found == brute([(i, v and [None if x is None else np.float32(x) for x in v]) for i, v in rows], 8, 3, 2, 1024, 3) and len(found[0]) == 3
    assert got(cluster(df.limit(0), 8, 3, 2)) == ([], []) and cluster(df.limit(0), 8, 3, 2)[0].columns == ["vec_id", "cluster", "distance"]


def test_what_does_not_fit_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e300]), (2, [0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        cluster(df, 2, 1, 1)[0].collect()


def test_sql_on_the_small_tables(spark, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{Path(sf) / 'embeddings.parquet'}')")
    want = con.execute(OP11_SQL)
    names = [d[0] for d in want.description]
    df = op11_centroids(spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.fetchall())
