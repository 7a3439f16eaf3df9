"""Operators whose rows must grow with the input: against plain loops, and on tables of copies."""

import math
import random

import pytest
from pyspark.sql import functions as F

from meridia.operators import planar as P
from meridia.operators import spatial as G
from meridia.plans import QUERIES

from .test_copies import copies, expect, km  # noqa: F401
from .test_rules import _outputs


def test_smallest_around_by_a_plain_loop(spark):
    # Nested and crowded boxes, equal sizes, points in many boxes and in none.
    rng = random.Random(3)
    boxes = [(i, -k, -k, k, k) for i, k in enumerate(x / 4 for x in range(1, 300))]
    boxes += [(1000 + i, x, y, x + 0.5, y + 0.25) for i, (x, y) in enumerate((rng.randint(-20, 20) / 4, rng.randint(-20, 20) / 4) for _ in range(400))]
    points = [(rng.uniform(-80, 80), rng.uniform(-80, 80)) for _ in range(80)] + [(rng.uniform(-4, 4), rng.uniform(-4, 4)) for _ in range(80)] + [(100.0, 0.0)] * 2 + [(None, 0.0)]
    b = spark.createDataFrame([(i, *map(float, r)) for i, *r in boxes], "part long, x0 double, y0 double, x1 double, y1 double")
    size = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    got = G.smallest_around(spark.createDataFrame(points, "lon double, lat double"), b.withColumn("rings", G.box_rings("x0", "y0", "x1", "y1")), "rings", "part", size)
    want = {}
    for x, y in set(points) - {(None, 0.0)}:
        around = [((u - x0) * (w - y0), i) for i, x0, y0, u, w in boxes if x0 <= x < u and y0 <= y < w]
        if around:
            want[x, y] = min(around)[1]
    assert {(r.lon, r.lat): r.part for r in got.collect()} == want and got.count() == len(want)


def test_smallest_around_without_polygons(spark):
    none = spark.createDataFrame([], f"part long, rings {G.RING}")
    got = G.smallest_around(spark.createDataFrame([(1.0, 2.0)], "lon double, lat double"), none, "rings", "part", F.lit(1.0))
    assert got.columns == ["lon", "lat", "part"] and got.count() == 0


@pytest.mark.parametrize("name", ["c13_pairwise_overlap", "i1_connected_components"])
def test_equal_zones_meet_others_once(spark, copies, monkeypatch, name):
    pairs = []
    box_pairs = G.box_pairs

    def counted(*args, **kwargs):
        out = box_pairs(*args, **kwargs)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(G, "box_pairs", counted)
    expect(copies, name, QUERIES[name](spark, copies))
    assert sum(pairs) <= 10 * 10  # ten places of two hundred zones


def test_gaps_look_only_into_the_pairs_asked_for(spark, copies, monkeypatch):
    # The seams of equal and nested diamonds, without all pairs of a zone and those that hold its corner.
    monkeypatch.setattr(G, "within", None)
    expect(copies, "c16_polygon_seams", QUERIES["c16_polygon_seams"](spark, copies))


@pytest.mark.parametrize("lat", [0.0, 60.0])
def test_points_are_a_row_each_where_sites_are_few(spark, monkeypatch, lat):
    # Many points around few sites: the sites look into cells, the points do not.
    seen = []
    near = G.near
    monkeypatch.setattr(G, "near", lambda left, right, *a, **k: seen.append((left.count(), right.count())) or near(left, right, *a, **k))
    points = [(179.003 + i / 100, lat + i % 7 / 10) for i in range(200)]
    sites = spark.createDataFrame([(1, 179.5, lat), (2, -179.5, lat)], "site long, x double, y double")
    got = {(r.lon, r.lat): r.site for r in G.nearest(spark.createDataFrame(points, "lon double, lat double"), sites, 200, 1, "site", "lon", "lat", "x", "y").collect()}
    assert all(a <= b for a, b in seen)
    want = {p: min((round(km(p, (x, lat)), 9), i) for i, x in ((1, 179.5), (2, -179.5))) for p in points}
    assert got == {p: i for p, (d, i) in want.items() if d <= 200}


def test_nearest_in_degrees_by_a_plain_loop(spark):
    rng = random.Random(5)
    sites = [(i, rng.gauss(0, 30), rng.uniform(-85, 85)) for i in range(400)] + [(1000 + i, 10.0, 20.0) for i in range(50)]
    points = [(rng.gauss(0, 40), rng.uniform(-88, 88)) for _ in range(150)] + [(10.1, 20.1)] * 3 + [(5.0, 90.0)]
    d = lambda p, s: math.sqrt(((p[0] - s[1]) * math.cos(math.radians(p[1]))) ** 2 + (p[1] - s[2]) ** 2)
    right = spark.createDataFrame(sites, "site long, x double, y double")
    df = G.nearest(spark.createDataFrame(points, "lon double, lat double"), right, 6.0, 1, "site", "lon", "lat", "x", "y", "deg", degrees=True)
    want = {p: min((round(d(p, s), 9), s[0]) for s in sites if d(p, s) <= 6.0) for p in set(points) if any(d(p, s) <= 6.0 for s in sites)}
    assert {(r.lon, r.lat): (round(r.deg, 9), r.site) for r in df.collect()} == want


def test_angular_match_of_copies(spark, copies):
    df = QUERIES["h32_angular_match"](spark, copies)
    expect(copies, "h32_angular_match", df)
    assert max(_outputs(df)) <= 3000  # a place has one row at most


def test_near_lines_past_the_date_line(spark, monkeypatch):
    # Points off the range of longitudes meet lines on the other side; each pair counts once, and points are not dealt over cells.
    monkeypatch.setattr(G, "box_pairs", None)
    lines = spark.createDataFrame([(1, -179.7, 0.0, -179.6, 0.1), (2, 179.8, 0.0, 180.3, 0.0), (3, 179.0, 0.05, 179.0, 0.05)], "line long, x0 double, y0 double, x1 double, y1 double")
    points = spark.createDataFrame([(1, 180.2, 0.0), (2, -179.9, 0.01), (3, 179.1, 0.05), (4, 0.0, 0.0)], "id long, lon double, lat double")
    got = sorted((r.id, r.line, round(r.metres)) for r in G.near_lines(points, lines, 20_000.0).collect())
    m = G.DEGREE
    assert got == [(1, 1, round(0.1 * m)), (1, 2, 0), (2, 2, round(0.01 * m)), (3, 3, round(0.1 * math.cos(math.radians(0.05)) * m))]


def test_equal_boxes_are_cut_once_on_all_cores(spark, copies):
    df = QUERIES["h31_wedges"](spark, copies)
    expect(copies, "h31_wedges", df)
    assert "REPARTITION_BY_NUM" in df._jdf.queryExecution().executedPlan().toString()


def test_ends_of_lines_do_not_meet_in_one_task(spark, monkeypatch):
    # Links are found without a join on a column that is null for all ends of lines.
    e = spark.createDataFrame([(i, float(i), 0.0, i + 1.0, 0.0, 2 * i, 2 * i + 1) for i in range(40)], "key long, x0 double, y0 double, x1 double, y1 double, a long, z long")
    plans, ranked = [], P.ranked

    def seen(links):
        plans.append(links._jdf.queryExecution().optimizedPlan().toString())
        return ranked(links)

    monkeypatch.setattr(P, "ranked", seen)
    assert P.lines(e.withColumn("g", F.lit(1)), ["g"], "a", "z", undirected="key").count() == 40
    assert plans[0].count("Join ") == 1
