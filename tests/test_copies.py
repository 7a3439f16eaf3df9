"""Queries on tables with many copies of points and boxes against their SQL, and the rows that their joins make."""

import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from meridia.operators import spatial as G
from meridia.plans import QUERIES, SQL

from .test_queries import SF, plain
from .test_rules import _outputs


@pytest.fixture(scope="module")
def copies(spark, tmp_path_factory):
    """Twenty copies of each table's rows; keys a multiple of 2772000 apart have the same places."""
    folder = tmp_path_factory.mktemp("copies")
    for name, key in (("customer", "c_custkey"), ("supplier", "s_suppkey"), ("part", "p_partkey")):
        duckdb.execute(f"COPY (SELECT * REPLACE (CAST({key} + i * 2772000 AS BIGINT) AS {key}) FROM '{SF}/{name}.parquet', (SELECT unnest(range(20)) AS i)) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def expect(folder, name, df):
    c = duckdb.connect()
    for t in ("customer", "supplier", "part"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    columns = sorted(df.columns)
    cursor = c.execute(SQL[name])
    names = [d[0] for d in cursor.description]
    want = sorted((tuple(plain(r[names.index(k)]) for k in columns) for r in cursor.fetchall()), key=repr)
    assert sorted((tuple(plain(r[k]) for k in columns) for r in df.collect()), key=repr) == want


@pytest.mark.parametrize("name", ["c15_probe_coverage", "k11_city_coverage", "c26_anchor_or_keyword", "c3_within_else_nearest"])
def test_points_in_boxes(spark, copies, name):
    df = QUERIES[name](spark, copies)
    expect(copies, name, df)
    assert max(_outputs(df)) <= 3000 + 200  # points, not points times copies of a box


@pytest.mark.parametrize("name", ["c2_nearest", "c29_gap_owner", "d22_inverse_distance_vote"])
def test_nearest(spark, copies, name):
    df = QUERIES[name](spark, copies)
    expect(copies, name, df)
    assert max(_outputs(df)) <= 3000  # a place has one row at most


def km(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1.0, math.sqrt(h)))


@pytest.mark.parametrize("k", [1, 3])
def test_nearest_by_a_plain_loop(spark, k):
    # A crowd, a few far away, copies, poles and the date line: some points need several rounds.
    rng = random.Random(k)
    sites = [(rng.gauss(10, 0.5), rng.gauss(50, 0.5)) for _ in range(300)] + [(179.9, -10.0), (-179.9, 10.0), (0.0, 89.0), (90.0, -89.5)]
    sites = [(i, *p) for i, p in enumerate(sites + sites[:40])]
    points = [(rng.uniform(-180, 180), rng.uniform(-90, 90)) for _ in range(60)] + [(rng.gauss(10, 2), rng.gauss(50, 2)) for _ in range(60)] + [(-179.5, -10.5)] * 2
    right = spark.createDataFrame(sites, "site long, x double, y double")
    got = G.nearest(spark.createDataFrame(points, "lon double, lat double"), right, 3000, k, "site", "lon", "lat", "x", "y")
    found = sorted((r.lon, r.lat, r.site) for r in got.collect())
    want = []
    for p in set(points):
        near = sorted((round(d, 6), i) for i, x, y in sites if (d := km(p, (x, y))) <= 3000)[:k]
        want += [(*p, i) for _, i in near]
    assert found == sorted(want)


@pytest.mark.parametrize("name", ["c5_polygon_adjacency", "c28_isolated"])
def test_pairs_of_zones(spark, copies, monkeypatch, name):
    pairs = []
    box_pairs = G.box_pairs

    def counted(*args, **kwargs):
        out = box_pairs(*args, **kwargs)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(G, "box_pairs", counted)
    expect(copies, name, QUERIES[name](spark, copies))
    assert sum(pairs) <= 40 * 40  # the edges of ten zones, not of two hundred
