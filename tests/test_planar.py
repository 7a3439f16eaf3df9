"""Planar maps: rings, noding and lines against plain walks on random maps."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from meridia.operators import planar as P

POLYGON = "array<array<struct<x:double,y:double>>>"


def rings_of(*rings):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in rings]


def box(x, y, w=1, h=1):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1])) / 2


def points(ring):
    return [(p.x, p.y) for p in ring]


def cells_frame(spark, owner):
    return spark.createDataFrame([(k, rings_of(box(*c))) for c, k in owner.items()], f"k string, rings {POLYGON}")


def edge_components(cells):
    """Numbers of 4-connected parts, and their sizes."""
    left, sizes = set(cells), []
    while left:
        todo, n = [left.pop()], 0
        while todo:
            x, y = todo.pop()
            n += 1
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in left:
                    left.remove(c)
                    todo.append(c)
        sizes.append(n)
    return sorted(sizes)


@pytest.mark.parametrize("seed", range(3))
def test_dissolve_of_random_maps(spark, seed):
    rng = random.Random(seed)
    owner = {(x, y): rng.choice("ab" if seed else "abc") for x in range(9) for y in range(8) if rng.random() < 0.9}
    df = cells_frame(spark, owner)
    e = P.directed(df, "rings")
    flat = P.rings(P.outline(e, ["k"]), ["k"]).collect()
    for k in set(owner.values()):
        own = [r for r in flat if r.k == k]
        cells = {c for c, o in owner.items() if o == k}
        assert math.isclose(sum(r.area for r in own), len(cells))
        assert len([r for r in own if r.area > 0]) == len(edge_components(cells))
        for r in own:
            p = points(r.points)
            assert math.isclose(area(p), r.area) and len(p) == r.corners and p[0] == min(p)
            assert all(abs(a[0] - b[0]) + abs(a[1] - b[1]) == 1 for a, b in zip(p, p[1:] + p[:1]))
    parts = P.dissolve(df, ["k"], "rings").collect()
    for k in set(owner.values()):
        assert sorted(round(r.area) for r in parts if r.k == k) == edge_components({c for c, o in owner.items() if o == k})
        assert all(len(r.rings) == r.holes + 1 for r in parts)


def test_a_hole_and_parts_that_touch_at_a_corner(spark):
    cells = {(x, y): "a" for x in range(5) for y in range(5)}
    del cells[2, 2]
    cells |= {(5, 5): "a", (2, 2): "b"}  # a part at the corner of the square; an island in its hole
    got = sorted((r.k, r.area, r.holes, r.rings and len(r.rings)) for r in P.dissolve(cells_frame(spark, cells), ["k"], "rings").collect())
    assert got == [("a", 1.0, 0, 1), ("a", 24.0, 1, 2), ("b", 1.0, 0, 1)]


def test_holes_go_to_the_nearest_ring_around_them(spark):
    frame = lambda n: {(x, y): "a" for x in range(n, 11 - n) for y in range(n, 11 - n) if x in (n, 10 - n) or y in (n, 10 - n)}
    cells = frame(0) | frame(2) | frame(4)
    got = sorted((r.area, r.holes) for r in P.dissolve(cells_frame(spark, cells), ["k"], "rings").collect())
    assert got == [(8.0, 1), (24.0, 1), (40.0, 1)]


def test_unnoded_maps_are_found_and_mended(spark):
    # Two boxes on top of each other beside one of both heights: a T-junction, and its noded twin.
    t = spark.createDataFrame([("g", rings_of(box(0, 0))), ("g", rings_of(box(0, 1))), ("g", rings_of(box(1, 0, 1, 2)))], f"k string, rings {POLYGON}")
    twin = spark.createDataFrame([("g", rings_of(box(0, 0))), ("g", rings_of(box(0, 1))), ("g", rings_of([(1, 0), (2, 0), (2, 2), (1, 2), (1, 1)]))], f"k string, rings {POLYGON}")
    e = P.directed(t, "rings")
    assert [(r.x, r.y) for r in P.contacts(e, ["k"]).collect()] == [(1.0, 1.0)]
    assert P.contacts(P.directed(twin, "rings"), ["k"]).count() == 0
    with pytest.raises(Exception, match="noded"):
        P.rings(P.outline(P.directed(spark.createDataFrame([("g", rings_of(box(0, 0))), ("g", rings_of([(1, 0), (2, 0), (2, 2), (1, 2)]))], f"k string, rings {POLYGON}"), "rings").where("NOT (x0 = 0 AND x1 = 0)"), ["k"]), ["k"]).collect()
    as_set = lambda df: {(r.x0, r.y0, r.x1, r.y1) for r in df.collect()}
    assert as_set(P.outline(P.noded(e, ["k"]), ["k"])) == as_set(P.outline(P.directed(twin, "rings"), ["k"]))
    assert [(r.area, r.corners) for r in P.rings(P.outline(P.noded(e, ["k"]), ["k"]), ["k"]).collect()] == [(4.0, 7)]


def test_members_that_overlap_are_an_error(spark):
    df = spark.createDataFrame([("g", rings_of(box(0, 0))), ("g", rings_of(box(0, 0)))], f"k string, rings {POLYGON}")
    with pytest.raises(Exception, match="overlap"):
        P.outline(P.directed(df, "rings"), ["k"]).collect()


def test_noding_of_random_segments(spark):
    rng = random.Random(4)
    rows = [tuple(float(rng.randint(0, 12)) for _ in range(4)) for _ in range(60)]
    rows = [r for r in rows if r[:2] != r[2:]] + [(0.0, 0.0, 12.0, 0.0)] + [(float(x), 0.0, float(x), 1.0) for x in range(13)]
    e = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double").withColumn("n", F.monotonically_increasing_id())
    out = P.noded(e)
    assert P.contacts(out.select("x0", "y0", "x1", "y1"), touch=1e-7).count() == 0
    parts = defaultdict(list)
    for r in out.collect():
        parts[r.n].append((r.x0, r.y0, r.x1, r.y1))
    for r in e.collect():
        n = math.hypot(r.x1 - r.x0, r.y1 - r.y0)
        assert math.isclose(sum(math.hypot(c - a, d - b) for a, b, c, d in parts[r.n]), n, rel_tol=1e-9)
        ends = [p[:2] for p in parts[r.n]] + [(r.x1, r.y1)]
        assert (r.x0, r.y0) in ends and all(any(p[2:] == q for q in ends) for p in parts[r.n])  # whole, and in the edge's direction
    base = sorted(parts[next(r.n for r in e.collect() if (r.x0, r.y0, r.x1, r.y1) == (0.0, 0.0, 12.0, 0.0))])
    assert {p[0] for p in base} >= set(map(float, range(12)))


def test_a_slanted_junction_bends_to_the_vertex(spark):
    third = 1 / 3
    e = spark.createDataFrame([(0.0, 0.0, 1.0, third), (0.3, 0.1, 0.3, 1.0), (0.0, 0.0, 0.5, -1.0)], "x0 double, y0 double, x1 double, y1 double")
    assert sorted((r.x0, r.y0, r.x1, r.y1) for r in P.noded(e).collect()) == [(0.0, 0.0, 0.3, 0.1), (0.0, 0.0, 0.5, -1.0), (0.3, 0.1, 0.3, 1.0), (0.3, 0.1, 1.0, third)]


def test_ranking_of_cycles_and_chains(spark):
    rng = random.Random(8)
    rows, want, at = [], {}, 0
    for n, closed in [(1, False), (1, True), (2, True), (4, True), (6, True), (7, True), (16, True), (33, True), (2, False), (5, False), (40, False)]:
        ids = list(range(at, at + n))
        at += n
        rng.shuffle(ids)
        rows += [(i, j, (i * 7919) % 1009) for i, j in zip(ids, ids[1:] + ([ids[0]] if closed else [None]), strict=True)]
        if closed:
            k = ids.index(min(ids, key=lambda i: (i * 7919) % 1009))
            ids = ids[k:] + ids[:k]
        want[ids[0] if closed else ids[-1]] = (closed, ids)
    got = defaultdict(list)
    for r in P.ranked(spark.createDataFrame(rows, "id long, next long, label long")).collect():
        got[r.chain].append((r.place, r.id, r.closed))
    assert {c: (v[0][2], [i for _, i, _ in sorted(v)]) for c, v in got.items()} == want


def test_lines_of_undirected_segments(spark):
    # A path of three segments that lie either way round, a closed triangle, a fork, and a loop.
    seg = [("a", 0, 0, 1, 0), ("b", 2, 0, 1, 0), ("c", 2, 0, 3, 1), ("d", 5, 5, 6, 5), ("e", 6, 6, 6, 5), ("f", 6, 6, 5, 5), ("g", 3, 1, 4, 4), ("h", 3, 1, 4, -4), ("l", 9, 9, 9, 9)]
    df = spark.createDataFrame([(s[0], *map(float, s[1:])) for s in seg], "id string, x0 double, y0 double, x1 double, y1 double").withColumns({"a": F.struct("x0", "y0"), "z": F.struct("x1", "y1")})
    df = df.withColumns({"a": F.concat_ws(" ", "x0", "y0"), "z": F.concat_ws(" ", "x1", "y1")})
    got = {r.line: (points(r.points), round(r.length, 9), r.closed) for r in P.lines(df, [], "a", "z", undirected="id").collect()}
    assert got == {
        "a": ([(0, 0), (1, 0), (2, 0), (3, 1)], round(2 + math.sqrt(2), 9), False),
        "d": ([(5, 5), (6, 5), (6, 6), (5, 5)], round(2 + math.sqrt(2), 9), True),
        "g": ([(3, 1), (4, 4)], round(math.hypot(1, 3), 9), False), "h": ([(3, 1), (4, -4)], round(math.hypot(1, 5), 9), False), "l": ([(9, 9), (9, 9)], 0.0, False),
    }


def test_empty_maps(spark):
    none = spark.createDataFrame([], f"k string, rings {POLYGON}")
    assert P.dissolve(none, ["k"], "rings").count() == 0
    assert P.lines(P.directed(none, "rings").withColumn("a", F.lit("x")), [], "a", "a").count() == 0
