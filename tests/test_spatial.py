"""Joins of polygons, boxes and lines against plain loops, and the kernels on concave polygons and holes."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from meridia.functions import geometry as M
from meridia.operators import spatial as G

POLYGON = "array<array<struct<x:double,y:double>>>"
CONCAVE = [[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]]
HOLED = [[(1, -1), (6, -1), (6, 3), (1, 3)], [(2, 0), (2, 2), (5, 2), (5, 0), (4, 0)]]
U = [[(0, 0), (5, 0), (5, 4), (4, 4), (4, 1), (1, 1), (1, 4), (0, 4)]]


def rings(p, dx=0.0, dy=0.0):
    return [[{"x": float(x) + dx, "y": float(y) + dy} for x, y in r] for r in p]


def plain(rs):
    return [[(p["x"], p["y"]) for p in r] for r in rs]


def inside(p, x, y):
    n = 0
    for r in p:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            n += (ay <= y) != (by <= y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
    return n % 2 == 1


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def point_gap(p, a, b):
    d = (b[0] - a[0], b[1] - a[1])
    n = d[0] ** 2 + d[1] ** 2
    t = min(1, max(0, ((p[0] - a[0]) * d[0] + (p[1] - a[1]) * d[1]) / n)) if n else 0
    return math.hypot(p[0] - a[0] - t * d[0], p[1] - a[1] - t * d[1])


def edge_gap(a, b, c, d):
    o = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    if o(a, b, c) * o(a, b, d) < 0 and o(c, d, a) * o(c, d, b) < 0:
        return 0.0
    return min(point_gap(a, c, d), point_gap(b, c, d), point_gap(c, a, b), point_gap(d, a, b))


def polygon_gap(p, q):
    if inside(p, *q[0][0]) or inside(q, *p[0][0]):
        return 0.0
    edges = lambda z: [e for r in z for e in zip(r, r[1:] + r[:1])]
    return min(edge_gap(*e, *f) for e in edges(p) for f in edges(q))


def random_polygons(rng, n, big=False):
    out = []
    for k in range(n):
        size = rng.choice([0.02, 0.5, 3, 40 if big else 6])
        x, y = rng.uniform(-50, 50), rng.uniform(-50, 50)
        angles = sorted(rng.uniform(0, 2 * math.pi) for _ in range(rng.randint(3, 9)))
        out.append((k, [[(x + size * rng.uniform(0.3, 1) * math.cos(a), y + size * rng.uniform(0.3, 1) * math.sin(a)) for a in angles]]))
    return out


def test_boxes_of_every_size_meet_once(spark):
    rng = random.Random(1)
    rows = []
    for k in range(250):
        w = rng.choice([0, 1e-7, 0.01, 0.3, 4, 16, 60, 360])
        x, y = rng.uniform(-180, 180), rng.uniform(-90, 90)
        rows.append((k, x, y, x + w * rng.random(), y + w))
    rows += [(300, 0.0, 0.0, 4.0, 4.0), (301, 4.0, 4.0, 8.0, 8.0), (302, -4.0, 4.0, 0.0, 4.0)]
    a = spark.createDataFrame(rows, "a long, x0 double, y0 double, x1 double, y1 double")
    b = spark.createDataFrame(rows[::2] + [(400, *rows[0][1:])], "b long, u0 double, v0 double, u1 double, v1 double")
    got = sorted((r.a, r.b) for r in G.box_pairs(a, b, ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1")).collect())
    want = sorted((p[0], q[0]) for p in rows for q in rows[::2] + [(400, *rows[0][1:])] if p[1] <= q[3] and q[1] <= p[3] and p[2] <= q[4] and q[2] <= p[4])
    assert got == want
    same = G.box_pairs(a.withColumn("g", F.col("a") % 3), b.withColumn("h", F.col("b") % 3), ("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), [("g", "h")])
    assert sorted((r.a, r.b) for r in same.collect()) == [p for p in want if p[0] % 3 == p[1] % 3]


def test_points_in_polygons_of_every_size(spark):
    rng = random.Random(2)
    polys = random_polygons(rng, 60, big=True) + [(100, [[(-180, -90), (180, -90), (180, 90), (-180, 90)]])]
    pts = [(i, rng.uniform(-60, 60), rng.uniform(-60, 60)) for i in range(300)] + [(1000, None, 1.0)]
    df = spark.createDataFrame([(k, rings(p)) for k, p in polys] + [(101, None), (102, [])], f"pid long, rings {POLYGON}")
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    want = {(i, k) for i, x, y in pts[:-1] for k, p in polys if inside(p, x, y)}
    assert {(r.id, r.pid) for r in G.within(points, df, "rings").collect()} == {(r.id, r.pid) for r in G.within(points, df, "rings", key="pid").collect()} == want


def test_a_globe_is_some_rows(spark):
    globe = spark.createDataFrame([(-180.0, -90.0, 180.0, 90.0)], "a double, b double, c double, d double")
    assert G._dealt(globe, ("a", "b", "c", "d"), F.array(G.level(F.lit(360.0)))).count() <= 24


def test_polygons_that_share_a_point(spark):
    rng = random.Random(3)
    square = [[(0, 0), (1, 0), (1, 1), (0, 1)]]
    cases = [(900, square), (901, [[(1, 1), (2, 1), (2, 2)]]), (902, [[(1, 0.2), (2, 0.2), (2, 0.4), (1, 0.4)]]), (903, [[(0.2, 0.2), (0.3, 0.2), (0.3, 0.3)]]), (904, [[(1.01, 0), (2, 0), (2, 1)]]), (905, [[(x / 10, y / 10) for x, y in HOLED[0]], [(x / 10, y / 10) for x, y in HOLED[1]]]), (906, [[(0.3, 0.1), (0.4, 0.1), (0.4, 0.15)]])]
    polys = random_polygons(rng, 50) + cases
    df = spark.createDataFrame([(k, rings(p)) for k, p in polys], f"a long, rings {POLYGON}")
    two = df.select(F.col("a").alias("b"), F.col("rings").alias("rings2"))
    got = {(r.a, r.b) for r in G.intersecting(df, two, "a", "b", "rings", "rings2").collect()}
    assert got == {(i, j) for i, p in polys for j, q in polys if polygon_gap(p, q) <= 1e-9}
    assert {(900, 901), (900, 902), (900, 903)} <= got and (900, 904) not in got and (905, 906) not in got  # the last lies in the hole


def test_gaps_of_listed_pairs(spark):
    rng = random.Random(4)
    polys = random_polygons(rng, 40)
    df = spark.createDataFrame([(k, rings(p)) for k, p in polys] + [(98, []), (99, None)], f"a long, rings {POLYGON}")
    two = df.select(F.col("a").alias("b"), F.col("rings").alias("rings2"))
    wanted = [(i, j) for i in range(0, 40, 3) for j in range(1, 40, 5)] + [(98, 1), (1, 99), (500, 1), (3, 3)]
    got = {(r.a, r.b): r for r in G.gaps(spark.createDataFrame(wanted, "a long, b long"), df, two, "a", "b", "rings", "rings2", 0.5).collect()}
    assert set(got) == set(wanted)
    of = dict(polys)
    for (i, j), r in got.items():
        if i in of and j in of:
            assert math.isclose(r.distance, polygon_gap(of[i], of[j]), abs_tol=1e-9)
            assert math.isclose(math.hypot(r.x - r.u, r.y - r.v), r.distance, abs_tol=1e-9)
        else:
            assert r.distance is None and r.x is None


def test_points_near_lines(spark):
    rng = random.Random(5)
    pts = [(i, rng.choice([0, 100, 179.9, -179.9]) + rng.uniform(-0.1, 0.1), rng.choice([0, 55, 80]) + rng.uniform(-0.3, 0.3)) for i in range(120)]
    lines = []
    for k in range(80):
        x, y = rng.choice([0, 100, 179.9, -179.9]) + rng.uniform(-0.1, 0.1), rng.choice([0, 55, 80]) + rng.uniform(-0.3, 0.3)
        lines.append((k, x, y, x + rng.uniform(-0.5, 0.5), y + rng.uniform(-0.2, 0.2)))
    got = {(r.i, r.k): r.metres for r in G.near_lines(spark.createDataFrame(pts, "i long, lon double, lat double"), spark.createDataFrame(lines, "k long, x0 double, y0 double, x1 double, y1 double"), 9000).collect()}
    want = {}
    for i, x, y in pts:
        c = math.cos(math.radians(y))
        for k, x0, y0, x1, y1 in lines:
            d = min(point_gap((0, 0), ((x0 - x + t) * c, y0 - y), ((x1 - x + t) * c, y1 - y)) for t in (-360, 0, 360)) * G.DEGREE
            if d <= 9000:
                want[i, k] = d
    assert got.keys() == want.keys() and want and all(math.isclose(got[p], want[p], rel_tol=1e-9, abs_tol=1e-6) for p in want)


def test_clipping_gives_rings_of_the_right_area(spark):
    windows = {"rectangle": [(1, 0.5), (4.5, 0.5), (4.5, 2.5), (1, 2.5)], "clockwise": [(1, 2.5), (4.5, 2.5), (4.5, 0.5), (1, 0.5)], "half-plane": [(-100, -100), (100, 100), (-100, 300)], "wedge": [(2, 1), (60, 30), (10, 90)], "around": [(-9, -9), (9, -9), (9, 9), (-9, 9)], "elsewhere": [(20, 20), (21, 20), (21, 21)]}
    rows = [(f"{n} {w}", rings(p), rings([win])) for n, p in (("concave", CONCAVE), ("holed", HOLED), ("u", U)) for w, win in windows.items()]
    df = spark.createDataFrame([*rows, ("null", None, rings([windows["around"]]))], f"n string, rings {POLYGON}, w {POLYGON}")
    out = df.withColumn("cut", M.clip_rings("rings", F.col("w")[0])).withColumn("want", M.overlap_area("rings", "w")).collect()
    for r in out[:-1]:
        got = [abs(area(x)) for x in plain(r.cut)]
        assert math.isclose(got[0] - sum(got[1:]) if got else 0.0, r.want, abs_tol=1e-9), r.n
    assert out[-1].cut is None and [r.cut for r in out if r.n.endswith("elsewhere")] == [[], [], []]
    assert next(plain(r.cut) for r in out if r.n == "holed around") == [[(float(x), float(y)) for x, y in ring] for ring in HOLED]


def test_points_inside(spark):
    rng = random.Random(6)
    polys = [CONCAVE, HOLED, U, [[(0, 0), (10, 0), (10, 10), (0, 10)], [(1, 1), (9, 1), (9, 9), (1, 9)]]] + [p for _, p in random_polygons(rng, 60)]
    df = spark.createDataFrame([(k, rings(p)) for k, p in enumerate(polys)], f"k long, rings {POLYGON}")
    assert all(inside(polys[r.k], r.c.x, r.c.y) for r in df.select("k", M.inner_point("rings").alias("c")).collect())
    odd = spark.createDataFrame([(1, rings([[(1, 2), (1, 2)]])), (2, []), (3, None), (4, rings([[(0, 0), (4, 0), (0, 0)]]))], f"k long, rings {POLYGON}")
    assert {r.k: r.c and r.c.x for r in odd.select("k", M.inner_point("rings").alias("c")).collect()} == {1: 1.0, 2: None, 3: None, 4: 0.0}


def test_clip_ring_of_a_spike_outside():
    p = np.array([(0, 0), (3, 0), (3, 1), (0, 1)], float)
    assert M.clip_ring(p, np.array([(5, 5), (6, 5), (6, 6)], float)).shape == (0, 2)
