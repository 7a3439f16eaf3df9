"""Contours, regions, gaps, halves and culls against plain loops."""

import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridia.functions import geometry as M
from meridia.operators import grids, parts
from meridia.plans import QUERIES
from meridia.plans.planar import u_shapes
from meridia.sources.views import Layers

POLYGON = "array<array<struct<x:double,y:double>>>"


def rings(p):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]


def grid(spark, z):
    return spark.createDataFrame([(r, c, float(v)) for (r, c), v in z.items()], "r int, c int, value double")


def plain_segments(z, level):
    """Segments by square, each side's crossing by its name; higher ground on the left."""
    out = []
    for r, c in z:
        at = [(r, c), (r, c + 1), (r + 1, c + 1), (r + 1, c)]
        if not all(p in z for p in at):
            continue
        v = [z[p] for p in at]
        name = [(r, c, "h"), (r, c + 1, "v"), (r + 1, c, "h"), (r, c, "v")]
        begin = [k for k in range(4) if v[k] >= level > v[(k + 1) % 4]]
        end = [k for k in range(4) if v[k] < level <= v[(k + 1) % 4]]
        for b in begin:
            order = range(1, 4) if sum(v) / 4 >= level else range(3, 0, -1)
            e = next((b + i) % 4 for i in order if (b + i) % 4 in end)
            out.append((name[b], name[e]))
    return out


def place(z, side, level):
    r, c, way = side
    a, b = z[r, c], z[(r, c + 1) if way == "h" else (r + 1, c)]
    t = (level - a) / (b - a)
    return (c + t, float(r)) if way == "h" else (float(c), r + t)


def plain_lines(z, level):
    nxt = dict(plain_segments(z, level))
    out, done = [], set()
    for start in [s for s in nxt if s not in set(nxt.values())] + list(nxt):
        if start in done:
            continue
        line, at = [start], start
        while at in nxt and at not in done:
            done.add(at)
            at = nxt[at]
            line.append(at)
        p = [place(z, s, level) for s in line]
        out.append((round(sum(math.dist(a, b) for a, b in zip(p, p[1:])), 6), line[0] == line[-1]))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_contours_against_walking_the_squares(spark, seed):
    rng = random.Random(seed)
    z = {(r, c): rng.choice([5, 10, 15, 20, 25, 30]) if seed else 20 + 12 * math.sin(r / 2) * math.cos(c / 3) for r in range(14) for c in range(12) if rng.random() < 0.97}
    got = defaultdict(list)
    for r in grids.contours(grid(spark, z), "value", 10).collect():
        got[r.level].append((round(r.length, 6), r.closed))
        assert all(a != b for a, b in zip(r.points, r.points[1:]))
    want = {float(v): sorted(plain_lines(z, v)) for v in range(10, 40, 10) if plain_lines(z, v)}
    assert {k: sorted(v) for k, v in got.items()} == want
    minor = {r.level for r in grids.contour_segments(grid(spark, z), "value", 5, without=10).select("level").distinct().collect()}
    assert minor and all(v % 10 == 5 for v in minor)


def test_a_hill_has_closed_rings_with_the_top_on_the_left(spark):
    z = {(r, c): max(35 - 10 * (abs(r - 4) + abs(c - 4)), 1) for r in range(9) for c in range(9)}
    for r in grids.contours(grid(spark, z), "value", 10).collect():
        p = np.array([(q.x, q.y) for q in r.points])
        assert r.closed and (p[0] == p[-1]).all() and M.shoelace(p[:-1]) > 0
    assert grids.contours(grid(spark, {(0, 0): 1.0, (0, 1): 99.0}), "value", 10).count() == 0  # no square of four


def test_band_boundaries_stop_at_the_coast(spark):
    z = {(r, c): 5 if c < 3 else 15 for r in range(4) for c in range(6)}
    (line,) = grids.band_boundaries(grid(spark, z), "value", [10.0]).collect()
    assert (line.level, line.length, line.closed) == (10.0, 4.0, False) and [(p.x, p.y) for p in line.points] == [(3.0, float(y)) for y in range(5)]
    island = {(r, c): 15 if (r, c) == (2, 2) else 5 for r in range(5) for c in range(5)}
    (ring,) = grids.band_boundaries(grid(spark, island), "value", [10.0]).collect()
    assert ring.closed and ring.length == 4.0


def test_cells_of_polygons(spark):
    rng = random.Random(3)
    polys = [[[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]], [[(1, -1), (6, -1), (6, 3), (1, 3)], [(2, 0), (2, 2), (5, 2), (5, 0)]], [[(0.1, 0.1), (0.2, 0.1), (0.2, 0.2)]]]
    polys += [[[(rng.uniform(-5, 5), rng.uniform(-5, 5)) for _ in range(5)]] for _ in range(20)]

    def inside(p, x, y):
        n = 0
        for r in p:
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
                n += (ay <= y) != (by <= y) and x < ax + (y - ay) / (by - ay) * (bx - ax)
        return n % 2 == 1

    df = spark.createDataFrame([(k, rings(p)) for k, p in enumerate(polys)] + [(98, []), (99, None)], f"k long, rings {POLYGON}")
    got = {(r.k, r.r, r.c) for r in grids.polygon_cells(df, "rings", 0.3).collect()}
    assert got == {(k, r, c) for k, p in enumerate(polys) for r in range(-20, 25) for c in range(-20, 25) if inside(p, (c + 0.5) * 0.3, (r + 0.5) * 0.3)}


def test_gap_samples_lie_in_gaps(spark):
    sf = "/root/testdata/sf0.01"
    v = Layers(spark, sf)
    units, zones = v.units.collect(), v.zones.collect()
    rows = QUERIES["d5_gap_samples"](spark, sf).collect()
    assert rows and max(r.n for r in rows) <= 5
    for r in rows:
        own = [u for u in units if u.group_id == r.group_id]
        assert min(u.xmin for u in own) - 2 <= r.x <= max(u.xmax for u in own) + 2
        # A cell counts as open by its middle, so a point may lie up to half a cell inside a zone.
        assert not any(z.zone_id % 5 == r.group_id and z.xmin + 2 < r.x < z.xmax - 2 and z.ymin + 2 < r.y < z.ymin + 6 for z in zones)


def test_halves_are_those_of_one_by_one(spark, sf):
    df = u_shapes(Layers(spark, sf)).select("zone_id", "rings")
    shapes = [(r.zone_id, "", [np.array([(q.x, q.y) for q in x]) for x in r.rings]) for r in df.collect()]
    size = lambda p: round(sum(abs(M.shoelace(x)) * (1 if k == 0 else -1) for k, x in enumerate(p)), 9)
    for target in (len(shapes), len(shapes) + 1, len(shapes) * 4):
        now = list(shapes)
        while len(now) < target:
            k = min(range(len(now)), key=lambda i: (-size(now[i][2]), len(now[i][1]), now[i][0], now[i][1]))
            key, path, p = now.pop(k)
            (x0, y0), (x1, y1) = p[0].min(0), p[0].max(0)
            for h in (0, 1):
                w = [x0, y0, x1, y1]
                side = 0 if x1 - x0 >= y1 - y0 else 1
                w[side if h else side + 2] = (w[side] + w[side + 2]) / 2
                box = np.array([(w[0], w[1]), (w[2], w[1]), (w[2], w[3]), (w[0], w[3])])
                now.append((key, path + str(h), [c for c in (M.clip_ring(x, box) for x in p) if len(c) > 2]))
        got = sorted((r.zone_id, r.path, round(r.area, 6)) for r in parts.bisect_to(df.withColumn("rings", F.col("rings")), "zone_id", "rings", target).collect())
        assert got == sorted((k, p, round(size(s), 6)) for k, p, s in now) and len(got) == max(target, len(shapes))


def test_what_has_no_area_is_not_cut(spark):
    df = spark.createDataFrame([(1, rings([[(0, 0), (1, 0), (1, 1), (0, 1)]])), (2, rings([[(0, 0), (1, 0)]])), (3, [])], f"k long, rings {POLYGON}")
    assert sorted((r.k, r.path) for r in parts.bisect_to(df, "k", "rings", 5).collect()) == [(1, "00"), (1, "01"), (1, "1"), (2, ""), (3, "")]


def test_cull_keeps_the_protected_and_the_largest(spark):
    box = lambda x, w: rings([[(x, 0), (x + w, 0), (x + w, w), (x, w)]])
    f = spark.createDataFrame([(1, "g", [box(0, 5), box(10, 1), box(20, 1)]), (2, "g", [box(30, 1)]), (3, "h", [box(40, 0.5), box(50, 0.4)]), (4, None, [box(60, 0.1)])], f"k long, g string, parts array<{POLYGON}>")
    p = spark.createDataFrame([(20.5, 0.5)], "lon double, lat double")
    got = {r.k: len(r.parts) for r in parts.cull_parts(f, "k", "g", "parts", 9.0, p).collect()}
    assert got == {1: 2, 3: 1, 4: 1}
    assert {r.k: len(r.parts) for r in parts.cull_parts(f, "k", "g", "parts", 9.0).collect()} == {1: 1, 3: 1, 4: 1}
    assert parts.cull_parts(f.limit(0), "k", "g", "parts", 9.0).count() == 0
