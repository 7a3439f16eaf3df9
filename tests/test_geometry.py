import math
import random

import numpy as np
from pyspark.sql import functions as F

from meridia.functions import geometry as M
from meridia.functions import scalars as S
from meridia.operators import edits, graph
from meridia.operators import spatial as G

CONCAVE = [[(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]]
HOLED = [[(1, -1), (6, -1), (6, 3), (1, 3)], [(2, 0), (2, 2), (5, 2), (5, 0)]]
POLYGON = "array<array<struct<x:double,y:double>>>"


def rings(p):
    return [[{"x": float(x), "y": float(y)} for x, y in r] for r in p]


def inside(p, x, y):
    n = 0
    for r in p:
        for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1]):
            if (ay <= y) != (by <= y) and x < ax + (y - ay) / (by - ay) * (bx - ax):
                n += 1
    return n % 2 == 1


def test_containment_of_concave_and_holed_polygons(spark):
    rng = random.Random(1)
    pts = [(i, rng.uniform(-1, 7), rng.uniform(-2, 5)) for i in range(400)] + [(1000, 0.0, 0.0), (1001, 4.0, 0.0), (1002, 2.0, 0.0)]
    points = spark.createDataFrame(pts, "id long, lon double, lat double")
    polys = spark.createDataFrame([(1, rings(CONCAVE)), (2, rings(HOLED)), (3, None)], f"pid long, rings {POLYGON}")
    got = {(r.id, r.pid) for r in G.within(points, polys, "rings").collect()}
    assert got == {(i, k) for i, x, y in pts for k, p in ((1, CONCAVE), (2, HOLED)) if inside(p, x, y)}


def test_touching_boxes_share_no_point(spark):
    boxes = spark.createDataFrame([(k, float(k % 3), float(k // 3), k % 3 + 1.0, k // 3 + 1.0) for k in range(9)], "pid long, xmin double, ymin double, xmax double, ymax double")
    points = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate([(1.0, 1.0), (0.0, 0.0), (2.0, 0.5), (1.5, 2.0), (3.0, 3.0)])], "id long, lon double, lat double")
    got = G.within(points, boxes.select("pid", G.box_rings("xmin", "ymin", "xmax", "ymax").alias("rings")), "rings")
    assert sorted((r.id, r.pid) for r in got.collect()) == [(0, 4), (1, 0), (2, 2), (3, 7)]
    # Dissolving the 3 x 3 square leaves its outline: 12 edges of the grid.
    e = G.edges(boxes.select(F.lit(1).alias("g"), G.box_rings("xmin", "ymin", "xmax", "ymax").alias("rings")), "rings")
    assert e.groupBy("g", "x0", "y0", "x1", "y1").count().where("count % 2 = 1").count() == 12


def test_overlap_area_against_sampling(spark):
    df = spark.createDataFrame([(rings(CONCAVE), rings(HOLED)), (rings(HOLED), rings(CONCAVE)), (rings(HOLED), rings(HOLED)), (rings(CONCAVE), None)], f"a {POLYGON}, b {POLYGON}")
    got = [r[0] for r in df.select(M.overlap_area("a", "b")).collect()]
    n, step = 0, 0.01
    for i in range(700):
        for j in range(700):
            x, y = i * step + 0.0037, j * step - 2 + 0.0041
            n += inside(CONCAVE, x, y) and inside(HOLED, x, y)
    assert math.isclose(got[0], n * step * step, abs_tol=0.03) and math.isclose(got[0], got[1]) and math.isclose(got[2], 14.0) and got[3] is None
    own = df.select(M.area(F.col("b")), M.centroid(F.col("a")[0])["x"], M.signed_area(F.reverse(F.col("a")[0]))).first()
    assert math.isclose(own[0], 14.0) and own[2] < 0


def test_near_points_across_the_date_line_and_at_high_latitudes(spark):
    rng = random.Random(2)
    a = [(i, rng.choice([-179.9, 179.8, 0.0, 90.0]) + rng.uniform(-0.1, 0.1), rng.choice([0, 60, 84, -88]) + rng.uniform(-1, 1)) for i in range(200)]
    b = [(i, rng.choice([-179.9, 179.8, 0.0, 90.0]) + rng.uniform(-0.1, 0.1), rng.choice([0, 60, 84, -88]) + rng.uniform(-1, 1)) for i in range(200)]
    left, right = spark.createDataFrame(a, "i long, lon double, lat double"), spark.createDataFrame(b, "j long, x double, y double")
    got = {(r.i, r.j) for r in G.near(left, right, 60, "lon", "lat", "x", "y").collect()}
    km = S.haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y"))
    assert got == {(r.i, r.j) for r in left.crossJoin(right).where(km <= 60).collect()} and got


def test_simplify_keeps_ends_and_tolerance():
    p = np.array([(x, math.sin(x / 3)) for x in range(60)], float)
    keep = M.douglas_peucker(p, 0.2)
    assert keep[0] and keep[-1] and 4 < keep.sum() < 40
    q = p[keep]
    assert np.abs(np.interp(p[:, 0], q[:, 0], q[:, 1]) - p[:, 1]).max() < 0.35


def test_text_keys(spark):
    df = spark.createDataFrame([("  São  Tomé’s / Große-Straße|東京 ",), (None,), ("",)], "t string")
    got = df.select(S.latin_key(F.col("t")), S.slug(F.col("t")), S.alias_split(F.col("t")), S.code_from_id(F.col("t"))).collect()
    assert got[0][0] == "sao tome's grosse strasse" and got[0][1] == "sao-tomes-grosse-strasse" and got[0][2] == ["São  Tomé’s", "Große-Straße", "東京"]
    assert got[1][0] is None and got[2][2] == [] and got[2][3] == "UNK"


def test_log_out_of_order_and_layers(spark):
    log = spark.createDataFrame([(3, 1, None), (1, 1, "a"), (2, 2, "b"), (4, 2, "c"), (5, 3, None)], "seq long, k long, v string")
    assert [tuple(r) for r in edits.latest(log, "k", "seq", "v").collect()] == [(2, "c")]
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string"), spark.createDataFrame([(2, None), (3, "z")], "k long, v string")
    assert sorted(tuple(r) for r in edits.layered([a, b], "k", "v").collect()) == [(1, "x", 0), (2, None, 1), (3, "z", 1)]
    assert {(r.k, r.change) for r in edits.diff(a, b, "k", "v").collect()} == {(1, "removed"), (2, "changed"), (3, "added")}


def test_components_of_a_long_chain(spark):
    n = 200
    nodes = spark.range(n + 2).withColumnRenamed("id", "id")
    edges = spark.range(n - 1).select(F.col("id").alias("dst"), (F.col("id") + 1).alias("src"))
    got = {r.id: r.component for r in graph.components(nodes, edges).collect()}
    assert all(got[i] == 0 for i in range(n)) and got[n] == n and got[n + 1] == n + 1


def test_greedy_colours_are_those_of_one_by_one(spark):
    rng = random.Random(7)
    pairs = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(90)}
    got = {r.id: r.colour for r in graph.greedy_colours(spark.range(42), spark.createDataFrame(sorted(pairs), "src long, dst long")).collect()}
    near = {i: {b if a == i else a for a, b in pairs if i in (a, b)} for i in range(42)}
    want = {}
    for i in sorted(range(42), key=lambda i: (-len(near[i]), i)):
        want[i] = next(c for c in range(50) if c not in {want.get(j) for j in near[i]})
    assert got == want


def test_scaled_threshold_reaches_its_target(spark, sf):
    from meridia.plans import QUERIES

    seats = [r.seats for r in QUERIES["e12_scaled_threshold"](spark, sf).collect()]
    assert abs(sum(seats) - 300) <= len(seats) and min(seats) >= 1 and max(seats) <= 60


def test_budget_selection_passes_over_what_does_not_fit(spark, sf):
    from meridia.plans import QUERIES

    for r in QUERIES["e8_budget_selection"](spark, sf).collect():
        assert r.used == sum(i % 7 + 1 for i in r.ids) <= 20
