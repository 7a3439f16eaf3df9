"""Points near lines: code that the JVM compiles, lines all around the globe, equal depots."""

import math
import random
import re

import pytest

from meridia.operators import spatial as G
from meridia.plans import QUERIES

from .test_copies import copies, expect  # noqa: F401

LINES = "line long, x0 double, y0 double, x1 double, y1 double"
POINTS = "id long, lon double, lat double"


def sizes(df, capsys):
    """Bytes of the longest generated method of each stage."""
    capsys.readouterr()
    df.explain("codegen")
    return [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]


def test_the_code_for_pairs_is_short_enough_to_be_compiled(spark, capsys):
    # The JVM never compiles methods of 8000 bytes and more, which then run many times slower.
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        found = G.near_lines(spark.createDataFrame([(1, 0.0, 0.0)], POINTS), spark.createDataFrame([(1, 0.0, 0.0, 0.1, 0.1)], LINES), 20_000.0)
        assert max(sizes(found.groupBy("id").min("metres"), capsys)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@pytest.mark.parametrize("metres", [20_000.0, 400_000.0])
def test_lines_around_the_globe_by_a_plain_loop(spark, metres):
    # Lines of more than a turn hold a point in several turns, yet make one pair.
    rng = random.Random(2)
    lines = [(1, -200.0, 10.0, 200.0, 12.0), (2, -180.0, -60.0, 180.0, -60.0), (3, 170.0, 5.0, 185.0, 5.5)]
    lines += [(10 + i, (x := rng.uniform(-181, 181)), (y := rng.uniform(-70, 70)), x + rng.uniform(0, 2), y + rng.uniform(-1, 1)) for i in range(150)]
    points = [(i, rng.uniform(-190, 190), rng.uniform(-70, 70)) for i in range(150)] + [(200, 180.0, 11.1), (201, -180.0, 10.9), (202, 179.99, -60.1), (203, -179.99, 5.2)]

    def gap(p, e, t):
        k = math.cos(math.radians(p[2]))
        ax, ay, qx, qy = (e[1] + t - p[1]) * k, e[2] - p[2], (e[3] + t - p[1]) * k, e[4] - p[2]
        n = (qx - ax) ** 2 + (qy - ay) ** 2
        s = max(0.0, min(1.0, -(ax * (qx - ax) + ay * (qy - ay)) / n))
        return math.hypot(ax + s * (qx - ax), ay + s * (qy - ay)) * G.DEGREE

    want = sorted((p[0], e[0], round(d, 3)) for p in points for e in lines if (d := min(gap(p, e, t) for t in (0.0, 360.0, -360.0))) <= metres)
    got = G.near_lines(spark.createDataFrame(points, POINTS), spark.createDataFrame(lines, LINES), metres)
    assert sorted((r.id, r.line, round(r.metres, 3)) for r in got.collect()) == want


def test_equal_depots_are_one(spark, copies, monkeypatch, tmp_path):  # noqa: F811
    # Twenty copies of each depot make no more edges than one.
    (tmp_path / "lineitem.parquet").symlink_to("/root/testdata/sf0.001/lineitem.parquet")
    for t in ("customer", "supplier", "part"):
        (tmp_path / f"{t}.parquet").symlink_to(f"{copies}/{t}.parquet")
    seen = []
    near_lines = G.near_lines
    monkeypatch.setattr(G, "near_lines", lambda points, lines, *a: (seen.append(lines.count()), near_lines(points, lines, *a))[1])
    QUERIES["c8_line_sections"](spark, str(tmp_path)).collect()
    assert seen == [20]
