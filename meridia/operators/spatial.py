"""Spatial joins as equi-joins on grid cells with an exact test behind them, so that Spark deals and splits the work.

Cells come in levels, each four times as wide as the one below. A shape lies in the cells of the level of its own size, nine
by nine at most, be it a street or the whole globe; points and lesser shapes look into the cells around them on every level
that the other side has. Cells carry boxes and keys alone; polygons are joined by key behind the test of the boxes.

A polygon is an array of rings, a ring an array of points (x, y), closed or not; holes are further rings. A point on an
edge belongs to the polygon on its right or above, so that touching polygons share no point. Null geometry joins nothing.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.functions.scalars import haversine_km
from meridia.sources.shared import scratch

from .selection import running

#: Square kilometres of the globe.
EARTH_AREA = 5.1e8

RING = "array<array<struct<x:double,y:double>>>"


def box_rings(xmin: str, ymin: str, xmax: str, ymax: str) -> Column:
    """A box as a polygon of one ring."""
    p = lambda x, y: F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
    return F.array(F.array(p(xmin, ymin), p(xmax, ymin), p(xmax, ymax), p(xmin, ymax)))


def bounds(rings: Column) -> tuple[Column, Column, Column, Column]:
    xs, ys = F.transform(F.flatten(rings), lambda p: p["x"]), F.transform(F.flatten(rings), lambda p: p["y"])
    return F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd rule over all rings."""

    def crossings(ring: Column) -> Column:
        n = F.size(ring)

        def edge(acc: Column, i: Column) -> Column:
            a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
            spans = (a["y"] <= y) != (b["y"] <= y)
            at = a["x"] + (y - a["y"]) / (b["y"] - a["y"]) * (b["x"] - a["x"])
            return acc + F.when(spans & (x < at), 1).otherwise(0)

        return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), edge)

    return F.aggregate(rings, F.lit(0), lambda acc, r: acc + crossings(r)) % 2 == 1


def with_cells(df: DataFrame, size: float, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> DataFrame:
    """A row for each grid cell (cx, cy) that the box touches."""
    cell = lambda c: F.floor(c / size)
    return df.withColumn("cx", F.explode(F.sequence(cell(xmin), cell(xmax)))).withColumn("cy", F.explode(F.sequence(cell(ymin), cell(ymax))))


#: Least and greatest level; a cell of level k is 4 to the power k wide.
LEVELS = (-12, 6)


def level(width: Column, per: int = 8) -> Column:
    """The least level whose cells are an eighth of the width or more, or another share of it."""
    up = F.ceil(F.log(4.0, F.greatest(width, F.lit(4.0 ** LEVELS[0])) / per)).cast("int")
    return F.greatest(F.lit(LEVELS[0]), F.least(F.lit(LEVELS[1]), up))


def cell(c: Column, lv: Column) -> Column:
    return F.floor(c / F.pow(F.lit(4.0), lv)).cast("long")


def _levels(boxes: DataFrame, box: tuple[str, ...], per: int = 8) -> Column:
    """The levels that the boxes have, in a list of 19 at most: a scalar subquery."""
    return boxes.select(level(_width(box), per).alias("lv")).agg(F.sort_array(F.collect_set("lv"))).scalar()


def _width(box: tuple[str, ...]) -> Column:
    return F.greatest(F.col(box[2]) - F.col(box[0]), F.col(box[3]) - F.col(box[1]))


def _dealt(df: DataFrame, box: tuple[str, ...], levels: Column, when: Column | None = None) -> DataFrame:
    """A row for each of these levels (_lv) that when holds for, and each cell (_cx, _cy) there that the box touches."""
    x0, y0, x1, y1 = map(F.col, box)
    lv = F.col("_lv")
    out = df.withColumn("_lv", F.explode(levels))
    out = out if when is None else out.where(when)
    return out.withColumn("_cx", F.explode(F.sequence(cell(x0, lv), cell(x1, lv)))).withColumn("_cy", F.explode(F.sequence(cell(y0, lv), cell(y1, lv))))


def within(points: DataFrame, polygons: DataFrame, rings: str, lon: str = "lon", lat: str = "lat", key: str | None = None) -> DataFrame:
    """Pairs of a point and a polygon that holds it. Column names of the sides must differ. key: a column that no two polygons share; without
    one the polygons are written with a number of their own first."""
    shapes = polygons.where(F.size(F.flatten(rings)) > 0)
    if key is None:
        shapes = scratch(shapes.withColumn("_shape", F.monotonically_increasing_id()), "shapes")
    box = ("_x0", "_y0", "_x1", "_y1")
    boxed = shapes.select(F.col(key or "_shape").alias("_key"), *[c.alias(n) for c, n in zip(bounds(F.col(rings)), box, strict=True)])
    held = _dealt(boxed, box, F.array(level(_width(box))))
    at = points.withColumn("_lv", F.explode(_levels(boxed, box))).withColumns({"_cx": cell(F.col(lon), F.col("_lv")), "_cy": cell(F.col(lat), F.col("_lv"))})
    # Boxes are a row for each cell, which their table's size does not tell: never a broadcast.
    hit = at.join(held.hint("merge"), ["_lv", "_cx", "_cy"]).where((F.col(lon) >= F.col("_x0")) & (F.col(lon) <= F.col("_x1")) & (F.col(lat) >= F.col("_y0")) & (F.col(lat) <= F.col("_y1")))
    found = hit.drop("_lv", "_cx", "_cy", *box).join(shapes, F.col("_key") == F.col(key or "_shape"))
    return found.where(contains(F.col(rings), F.col(lon), F.col(lat))).drop("_key", "_shape")


def in_boxes(points: DataFrame, boxes: DataFrame, box: tuple[str, ...], lon: str = "lon", lat: str = "lat", same: list[str] | None = None) -> DataFrame:
    """Pairs of a point and a box that holds it, as within has them for polygons of these boxes; box: names of xmin, ymin, xmax, ymax. same: columns of both
    sides that must be equal. Where many points or boxes are equal, give each once: pairs are of all rows."""
    keys = ["_lv", "_cx", "_cy", *(same or [])]
    held = _dealt(boxes, box, F.array(level(_width(box))))
    at = points.withColumn("_lv", F.explode(_levels(boxes, box))).withColumns({"_cx": cell(F.col(lon), F.col("_lv")), "_cy": cell(F.col(lat), F.col("_lv"))})
    # Boxes are a row for each cell, which their table's size does not tell: never a broadcast.
    hit = at.join(held.hint("merge"), keys).where((F.col(lon) >= F.col(box[0])) & (F.col(lon) < F.col(box[2])) & (F.col(lat) >= F.col(box[1])) & (F.col(lat) < F.col(box[3])))
    return hit.drop("_lv", "_cx", "_cy")


def smallest_around(points: DataFrame, polygons: DataFrame, rings: str, key: str, size: Column, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """(lon, lat, key): for each different point in any polygon the one of least size, of equal sizes that of the least key, a unique column.

    Polygons go in order of size by classes, within which the area of their boxes, summed up in that order, grows sixteenfold; the first class covers a
    16th of the box around them all. A point meets a class only if no lesser one holds it: pairs grow with the points, not with points times polygons."""
    box = ("_x0", "_y0", "_x1", "_y1")
    boxed = dict(zip(box, bounds(F.col(rings)), strict=True))
    shapes = scratch(polygons.where(F.size(F.flatten(rings)) > 0).select(F.col(key).alias("_key"), rings, size.alias("_size")).withColumns(boxed), "shapes")
    wide, high = shapes.agg(F.max("_x1") - F.min("_x0"), F.max("_y1") - F.min("_y0")).first()  # one row
    unit = max((wide or 0.0) * (high or 0.0) / 16, 1e-9) / (1 << 20)
    area = F.ceil((F.col("_x1") - F.col("_x0")) * (F.col("_y1") - F.col("_y0")) / unit).cast("long")  # whole numbers, whose sums rise along the order
    summed = running(shapes.select("_key", "_size", *box, area.alias("_area")), [F.col("_size"), F.col("_key")], "_area", "_sum")
    nth = F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("_sum") / (1 << 20)))).cast("int")
    classes = scratch(summed.select("_key", "_size", *box, nth.alias("_class")), "classes")
    rest = scratch(points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(lon, lat).distinct(), "spots")
    cells, found = ["_lv", "_cx", "_cy"], []
    for (k,) in sorted(classes.select("_class").distinct().collect()):  # 20 at most
        # Few points are left for a box, so cells are as wide as it: a row for each of four cells.
        own = classes.where(F.col("_class") == k).drop("_class")
        at = rest.withColumn("_lv", F.explode(_levels(own, box, 1))).withColumns({"_cx": cell(F.col(lon), F.col("_lv")), "_cy": cell(F.col(lat), F.col("_lv"))})
        hit = at.join(_dealt(own, box, F.array(level(_width(box), 1))).hint("merge"), cells).where((F.col(lon) >= F.col("_x0")) & (F.col(lon) <= F.col("_x1")) & (F.col(lat) >= F.col("_y0")) & (F.col(lat) <= F.col("_y1")))
        held = hit.select(lon, lat, "_size", "_key").join(shapes.select("_key", rings).hint("merge"), "_key").where(contains(F.col(rings), F.col(lon), F.col(lat)))
        found.append(scratch(held.groupBy(lon, lat).agg(F.min(F.struct("_size", "_key"))["_key"].alias(key)), "smallest"))
        rest = scratch(rest.join(found[-1], [lon, lat], "left_anti"), "spots")
        if rest.isEmpty():
            break
    return reduce(DataFrame.unionByName, found) if found else rest.join(polygons.select(key).limit(0))


def near(left: DataFrame, right: DataFrame, km: float, lon: str, lat: str, lon2: str, lat2: str, distance: str = "km", same: list[tuple[str, str]] | None = None) -> DataFrame:
    """Pairs of points of at most km kilometres, with the distance; across the date line too. same: columns of the left and the right side that must be equal.

    Cells are km high; a left point looks into the rows of cells above and below and, in each, into as many columns as
    km is wide at the latitude of its far edge; close to a pole, into all.
    """
    step = km / 111.0
    columns = int(360 / step) + 1
    width = 360.0 / columns
    row = lambda c: F.floor((c + 90) / step)
    edge = F.least(F.abs(F.col(lat)) + 2 * step, F.lit(89.9))
    reach = F.least(F.lit(columns // 2 + 1), F.ceil(F.lit(km / 111.0) / F.cos(F.radians(edge)) / width) + 1)
    col = F.floor((F.col(lon) + 180) / width)
    at = left.withColumn("cy", F.explode(F.sequence(row(F.col(lat)) - 1, row(F.col(lat)) + 1)))
    at = at.withColumn("cx", F.explode(F.array_distinct(F.transform(F.sequence(col - reach, col + reach), lambda x: F.pmod(x, F.lit(columns))))))
    there = right.withColumn("cy", row(F.col(lat2))).withColumn("cx", F.pmod(F.floor((F.col(lon2) + 180) / width), F.lit(columns)))
    d = haversine_km(F.col(lon), F.col(lat), F.col(lon2), F.col(lat2))
    there = there.withColumnsRenamed({"cx": "_cx2", "cy": "_cy2"})
    on = [F.col("cx") == F.col("_cx2"), F.col("cy") == F.col("_cy2"), *[F.col(x) == F.col(y) for x, y in same or []]]
    # The left side is a row for each cell, which its table's size does not tell: never a broadcast.
    return at.join(there.hint("merge"), on).withColumn(distance, d).where(F.col(distance) <= km).drop("cx", "cy", "_cx2", "_cy2")


def near_degrees(left: DataFrame, right: DataFrame, degrees: float, lon: str, lat: str, lon2: str, lat2: str, distance: str = "deg") -> DataFrame:
    """Pairs of points of at most so many degrees on the plane that touches the globe at the left one, with the distance; not across the date line.
    Longitudes from -360 to 360. Cells are that high and wide; a left point looks into as many columns as the distance is wide at its latitude."""
    cut = lambda c: F.floor(c / degrees)
    wide = F.least(F.lit(720.0), degrees / F.greatest(F.cos(F.radians(F.col(lat))), F.lit(1e-9)))
    at = left.withColumn("cy", F.explode(F.sequence(cut(F.col(lat)) - 1, cut(F.col(lat)) + 1)))
    at = at.withColumn("cx", F.explode(F.sequence(cut(F.greatest(F.lit(-360.0), F.col(lon) - wide)) - 1, cut(F.least(F.lit(360.0), F.col(lon) + wide)) + 1)))
    there = right.withColumn("_cy2", cut(F.col(lat2))).withColumn("_cx2", cut(F.col(lon2)))
    d = F.sqrt(F.pow((F.col(lon) - F.col(lon2)) * F.cos(F.radians(F.col(lat))), 2) + F.pow(F.col(lat) - F.col(lat2), 2))
    # The left side is a row for each cell, which its table's size does not tell: never a broadcast.
    return at.join(there.hint("merge"), [F.col("cx") == F.col("_cx2"), F.col("cy") == F.col("_cy2")]).withColumn(distance, d).where(F.col(distance) <= degrees).drop("cx", "cy", "_cx2", "_cy2")


def nearest(points: DataFrame, right: DataFrame, km: float, k: int, order: str, lon: str, lat: str, lon2: str, lat2: str, distance: str = "km", degrees: bool = False) -> DataFrame:
    """(lon, lat, distance, right columns but its coordinates): for each different point the k nearest rows of right within km kilometres, of equal distances the
    first in order, a unique column of right. degrees: km and distance are degrees, as near_degrees has them.

    Equal points are one on both sides, with the first k rows on the right. The radius begins where about 2 k sites would lie in it if they were spread
    evenly, and doubles for points that have found fewer than k rows, up to km: pairs grow with the points, not with points times sites. Of points and sites
    the fewer look into the cells around them, so that the others are a row each."""
    rest = scratch(points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(lon, lat).distinct(), "spots")
    rows = [c for c in right.columns if c not in (lon2, lat2)]
    first = right.where(F.col(lon2).isNotNull() & F.col(lat2).isNotNull()).withColumn("_n", F.row_number().over(Window.partitionBy(lon2, lat2).orderBy(order))).where(F.col("_n") <= k)
    sites = scratch(first.groupBy(lon2, lat2).agg(F.collect_list(F.struct(order, *[c for c in rows if c != order])).alias("_rows")), "sites")
    n = sites.count()
    radius, even = km, (2 * k * EARTH_AREA / math.pi / max(1, n)) ** 0.5 / (111.0 if degrees else 1.0)
    while radius / 2 >= even:
        radius /= 2
    found = []
    while True:
        if degrees:
            pairs = near_degrees(rest, sites, radius, lon, lat, lon2, lat2, distance)
        elif rest.count() > n:
            pairs = near(sites, rest, radius, lon2, lat2, lon, lat, distance)
        else:
            pairs = near(rest, sites, radius, lon, lat, lon2, lat2, distance)
        each = pairs.select(lon, lat, distance, F.inline("_rows"))
        place = F.row_number().over(Window.partitionBy(lon, lat).orderBy(distance, order))
        best = each.withColumn("_n", place).where(F.col("_n") <= k)
        last = radius >= km
        if last:
            found.append(best.drop("_n"))
            break
        best = scratch(best, "nearest")
        done = scratch(best.where(F.col("_n") == k).select(lon, lat), "found")
        found.append(best.join(done, [lon, lat], "left_semi").drop("_n"))
        rest = scratch(rest.join(done, [lon, lat], "left_anti"), "spots")
        if rest.isEmpty():
            break
        radius = min(km, 2 * radius)
    return reduce(DataFrame.unionByName, found)


def box_overlap(a: tuple[str, ...], b: tuple[str, ...]) -> Column:
    """Area that two boxes (names of xmin, ymin, xmax, ymax) share, in square degrees."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def box_pairs(left: DataFrame, right: DataFrame, a: tuple[str, ...], b: tuple[str, ...], same: list[tuple[str, str]] | None = None, per: int = 8) -> DataFrame:
    """Pairs whose closed boxes meet, each once: of the cells that both touch only the first counts. same: columns of the left and the right side that
    must be equal, nulls to nulls. Column names of the sides must differ. per: cells across a box; fewer where most boxes meet many others.

    The lesser box of a pair looks for the greater one on its level: _role tells a box in its own cells from one that looks. Boxes that no lesser
    one can look for are in no cells of their own.
    """
    la, lb = level(_width(a), per), level(_width(b), per)
    all_a, all_b = _levels(left, a, per), _levels(right, b, per)
    own = lambda df, box, lv, role, when: _dealt(df.withColumn("_role", F.lit(role)), box, F.array(lv), when)
    seen = lambda df, box, levels, role, when: _dealt(df.withColumn("_role", F.lit(role)), box, levels, when)
    one = own(left, a, la, 0, F.array_min(all_b) < F.col("_lv")).unionByName(seen(left, a, all_b, 1, F.col("_lv") >= la))
    two = own(right, b, lb, 1, F.array_min(all_a) <= F.col("_lv")).unionByName(seen(right, b, all_a, 0, F.col("_lv") > lb))
    keys = ["_role", "_lv", "_cx", "_cy"]
    two = two.select(*[F.col(k).alias(k + "2") for k in keys], *right.columns)
    on = [F.col(k) == F.col(k + "2") for k in keys] + [F.col(x).eqNullSafe(F.col(y)) for x, y in same or []]
    first = (F.col("_cx") == cell(F.greatest(a[0], b[0]), F.col("_lv"))) & (F.col("_cy") == cell(F.greatest(a[1], b[1]), F.col("_lv")))
    meet = (F.col(a[0]) <= F.col(b[2])) & (F.col(b[0]) <= F.col(a[2])) & (F.col(a[1]) <= F.col(b[3])) & (F.col(b[1]) <= F.col(a[3]))
    # Boxes are a row for each cell, which their table's size does not tell: never a broadcast.
    return one.join(two.hint("merge"), on).where(meet & first).select(*left.columns, *right.columns)


def segment_gap(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, dx: Column, dy: Column) -> Column:
    """(distance, x, y, u, v): the least distance of the segments a b and c d, and their nearest points, x y on the first and u v on the second. Of equal
    distances an end of the first comes before one of the second; segments that cross have the crossing as both points."""

    def foot(px, py, ex, ey, fx, fy, swap: bool) -> Column:
        n = (fx - ex) * (fx - ex) + (fy - ey) * (fy - ey)
        t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ex) * (fx - ex) + (py - ey) * (fy - ey)) / F.when(n > 0, n)))).otherwise(0.0)
        qx, qy = ex + t * (fx - ex), ey + t * (fy - ey)
        x, y, u, v = (qx, qy, px, py) if swap else (px, py, qx, qy)
        return F.struct(F.hypot(px - qx, py - qy).alias("distance"), x.alias("x"), y.alias("y"), u.alias("u"), v.alias("v"))

    orient = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)
    da, db = orient(cx, cy, dx, dy, ax, ay), orient(cx, cy, dx, dy, bx, by)
    cross = (da * db < 0) & (orient(ax, ay, bx, by, cx, cy) * orient(ax, ay, bx, by, dx, dy) < 0)
    at = da / F.when(cross, da - db)
    mx, my = ax + (bx - ax) * at, ay + (by - ay) * at
    met = F.struct(F.lit(0.0).alias("distance"), mx.alias("x"), my.alias("y"), mx.alias("u"), my.alias("v"))
    best = F.least(foot(ax, ay, cx, cy, dx, dy, False), foot(bx, by, cx, cy, dx, dy, False), foot(cx, cy, ax, ay, bx, by, True), foot(dx, dy, ax, ay, bx, by, True))
    return F.when(cross, met).otherwise(best)


#: Metres of a degree of latitude on a globe of the mean radius.
DEGREE = 6_371_008.8 * 3.141592653589793 / 180


def near_lines(points: DataFrame, lines: DataFrame, metres: float, lon: str = "lon", lat: str = "lat", distance: str = "metres") -> DataFrame:
    """Pairs of a point and an edge (x0, y0, x1, y1) of lines within that many metres, with the distance; across the date line too. Metres are those
    of the plane that touches the globe at the point, so they hold for tens of kilometres. Column names of the sides must differ."""
    high = metres / DEGREE
    wide = lambda far: F.least(F.lit(180.0), high / F.cos(F.radians(F.least(far + high, F.lit(89.9)))))
    # Points are a row each and lie in the boxes of lines, widened by the reach; a box over the date line, or close to it, is there once more a turn further.
    least, most, reach = F.least("x0", "x1"), F.greatest("x0", "x1"), wide(F.greatest(F.abs("y0"), F.abs("y1")) + high) + 1e-9
    turn = F.array_compact(F.array(F.lit(0.0), F.when(least - reach <= -180, F.lit(360.0)), F.when(most + reach >= 180, F.lit(-360.0))))
    there = lines.withColumn("_turn", F.explode(turn)).withColumns({"_u0": least - reach + F.col("_turn"), "_v0": F.least("y0", "y1") - high - 1e-9, "_u1": most + reach + F.col("_turn"), "_v1": F.greatest("y0", "y1") + high + 1e-9})
    at = points.withColumn("_shift", F.floor((F.col(lon) + 180) / 360) * 360.0).withColumns({"_lon": F.col(lon) - F.col("_shift"), "_k": F.cos(F.radians(F.col(lat)))})
    pairs = in_boxes(at, there, ("_u0", "_v0", "_u1", "_v1"), "_lon", lat)

    def ends(t: Column) -> list[Column]:
        """The edge's ends a turn further, seen from the point."""
        x = lambda c: (F.col(c) + t - F.col(lon)) * F.col("_k")
        return [x("x0").alias("_ax"), (F.col("y0") - F.col(lat)).alias("_ay"), x("x1").alias("_qx"), (F.col("y1") - F.col(lat)).alias("_qy")]

    def gap(ax: Column, ay: Column, qx: Column, qy: Column) -> Column:
        n = F.pow(qx - ax, 2) + F.pow(qy - ay, 2)
        share = F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * (qx - ax) + ay * (qy - ay)) / n))).otherwise(0.0)
        return F.sqrt(F.pow(ax + share * (qx - ax), 2) + F.pow(ay + share * (qy - ay), 2)) * DEGREE

    turned = F.col("_turn") + F.col("_shift")
    if not lines.where(most - least + 2 * reach >= 360).isEmpty():
        # Only an edge all around the globe has several turns that hold a point: the nearest one counts.
        near = [F.struct(gap(*ends(F.lit(t))).alias("d"), F.lit(t).alias("turn")) for t in (0.0, 360.0, -360.0)]
        pairs = pairs.where(F.least(*near)["turn"] == turned)
    # The ends are columns of their own by an inline: Catalyst would write them out wherever the gap names them, in code too long for the JVM to compile.
    seen = pairs.select(*points.columns, *lines.columns, F.inline(F.array(F.struct(*ends(turned)))))
    found = seen.withColumn(distance, gap(*map(F.col, ("_ax", "_ay", "_qx", "_qy")))).where(F.col(distance) <= metres)
    return found.select(*points.columns, *lines.columns, distance)


def _edge_boxes(e: DataFrame, names: tuple[str, ...], reach: Column | float = 0.0) -> DataFrame:
    box = (F.least("x0", "x1") - reach, F.least("y0", "y1") - reach, F.greatest("x0", "x1") + reach, F.greatest("y0", "y1") + reach)
    return e.withColumns(dict(zip(names, box, strict=True)))


def _side(px: str, py: str, qx: str, qy: str, rx: str, ry: str) -> Column:
    """Twice the area of the triangle p q r, above 0 if r lies on the left of p q."""
    c = F.col
    return (c(qx) - c(px)) * (c(ry) - c(py)) - (c(qy) - c(py)) * (c(rx) - c(px))


def _apart(ax: str, ay: str, bx: str, by: str, cx: str, cy: str, dx: str, dy: str, touch: float) -> Column:
    """Whether c and d lie on one side of the line a b, further than touch from it."""
    reach = F.hypot(F.col(bx) - F.col(ax), F.col(by) - F.col(ay)) * touch
    one, two = _side(ax, ay, bx, by, cx, cy), _side(ax, ay, bx, by, dx, dy)
    return (F.least(one, two) > reach) | (F.greatest(one, two) < -reach)


def _cross(ax: str, ay: str, bx: str, by: str, cx: str, cy: str, dx: str, dy: str) -> Column:
    """Whether a b and c d have a point inside both in common."""
    return (_side(cx, cy, dx, dy, ax, ay) * _side(cx, cy, dx, dy, bx, by) < 0) & (_side(ax, ay, bx, by, cx, cy) * _side(ax, ay, bx, by, dx, dy) < 0)


def intersecting(left: DataFrame, right: DataFrame, a: str, b: str, rings: str, rings2: str, touch: float = 1e-9) -> DataFrame:
    """(a, b): pairs of polygons, named by the unique columns a and b, that share a point; a common corner is enough, up to touch. Edges meet by
    cells and no row has a whole polygon; pairs without edges that meet are those where one holds a vertex of the other."""
    e = _edge_boxes(edges(left.select(a, rings), rings), ("_x0", "_y0", "_x1", "_y1"), touch)
    f = _edge_boxes(edges(right.select(b, rings2), rings2), ("_u0", "_v0", "_u1", "_v1"))
    f = f.select(b, *[F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), strict=True)], "_u0", "_v0", "_u1", "_v1")
    met = box_pairs(e, f, ("_x0", "_y0", "_x1", "_y1"), ("_u0", "_v0", "_u1", "_v1"))
    # Most edges lie on one side of the other, or cross: a cheap test tells; the gap is worked out for the rest, which are those that touch.
    ends = ("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1")
    met = met.where(~_apart(*ends, touch) & ~_apart(*ends[4:], *ends[:4], touch)).select(a, b, *ends, _cross(*ends).alias("_cross"))
    met = scratch(met.select(a, b, "_cross", *[F.when(~F.col("_cross"), F.col(c)).alias(c) for c in ends]).distinct(), "met")
    crossed = met.where("_cross").select(a, b)
    open_ = met.where("NOT _cross").join(crossed, [a, b], "left_anti")
    met = crossed.unionByName(scratch(open_, "touching").where(segment_gap(*map(F.col, ends))["distance"] <= touch).select(a, b))
    corner = lambda df, k, r: df.where(F.size(F.flatten(r)) > 0).select(k, F.get(F.get(r, F.lit(0)), F.lit(0))["x"].alias("_lon"), F.get(F.get(r, F.lit(0)), F.lit(0))["y"].alias("_lat"))
    inside = within(corner(left, a, rings), right.select(b, rings2), rings2, "_lon", "_lat", b).select(a, b)
    holds = within(corner(right, b, rings2), left.select(a, rings), rings, "_lon", "_lat", a).select(a, b)
    return met.unionByName(inside).unionByName(holds).distinct()


def gaps(pairs: DataFrame, left: DataFrame, right: DataFrame, a: str, b: str, rings: str, rings2: str, reach: float) -> DataFrame:
    """pairs (a, b) with the gap of their polygons, named by the unique columns a and b: distance (0 if they share a point) and the nearest points x, y of
    a's and u, v of b's; null where a pair's polygons are not there. Edges meet by cells within reach; pairs that are
    further apart go through again with four times the reach, with their edges alone, until all are found."""
    wanted = scratch(pairs.select(a, b).distinct(), "gap-pairs")
    there = wanted.join(left.where(F.size(F.flatten(rings)) > 0).select(a), a, "left_semi").join(right.where(F.size(F.flatten(rings2)) > 0).select(b), b, "left_semi")
    one, two = edges(left.select(a, rings), rings), edges(right.select(b, rings2), rings2)
    two = _edge_boxes(two, ("_u0", "_v0", "_u1", "_v1")).select(F.col(b).alias("_b"), *[F.col(c).alias(n) for c, n in zip(("x0", "y0", "x1", "y1"), ("u0", "v0", "u1", "v1"), strict=True)], "_u0", "_v0", "_u1", "_v1")
    # One polygon inside another has no edges that meet: a vertex of it tells.
    x, y = F.col("_lon"), F.col("_lat")

    def holding(one: DataFrame, k: str, r: str, two: DataFrame, m: str, s: str) -> DataFrame:
        """Pairs whose second polygon holds the first one's first vertex; boxes come before polygons."""
        corner = F.get(F.get(r, F.lit(0)), F.lit(0))
        at = wanted.join(one.where(F.size(F.flatten(r)) > 0).select(k, corner["x"].alias("_lon"), corner["y"].alias("_lat")), k)
        x0, y0, x1, y1 = (c.alias(n) for c, n in zip(bounds(F.col(s)), ("_u0", "_v0", "_u1", "_v1"), strict=True))
        boxed = at.join(two.where(F.size(F.flatten(s)) > 0).select(m, x0, y0, x1, y1), m).where((x >= F.col("_u0")) & (x <= F.col("_u1")) & (y >= F.col("_v0")) & (y <= F.col("_v1")))
        return boxed.select(a, b, "_lon", "_lat").join(two.select(m, s), m).where(contains(F.col(s), x, y)).select(a, b, "_lon", "_lat")

    held = holding(left, a, rings, right, b, rings2).unionByName(holding(right, b, rings2, left, a, rings)).select(a, b, F.struct(F.lit(0.0).alias("distance"), x.alias("x"), y.alias("y"), x.alias("u"), y.alias("v")).alias("g"))
    found = [scratch(held.groupBy(a, b).agg(F.min("g").alias("g")), "gaps")]
    rest = scratch(there.join(found[0], [a, b], "left_anti"), "gap-rest")
    while not rest.isEmpty():
        e = _edge_boxes(one.join(rest, a), ("_x0", "_y0", "_x1", "_y1"), reach)
        f = two.join(rest.select(F.col(b).alias("_b")).distinct(), "_b", "left_semi")
        met = box_pairs(e, f, ("_x0", "_y0", "_x1", "_y1"), ("_u0", "_v0", "_u1", "_v1"), [(b, "_b")])
        near = met.select(a, b, segment_gap(*map(F.col, ("x0", "y0", "x1", "y1", "u0", "v0", "u1", "v1"))).alias("g")).groupBy(a, b).agg(F.min("g").alias("g"))
        found.append(scratch(near.where(F.col("g.distance") <= reach), "gaps"))
        rest = scratch(rest.join(found[-1], [a, b], "left_anti"), "gap-rest")
        reach *= 4
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return wanted.join(every, [a, b], "left").select(a, b, "g.distance", "g.x", "g.y", "g.u", "g.v")


def box_distance(x: Column, y: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Distance in degrees of a point from a box; 0 inside."""
    return F.hypot(F.greatest(xmin - x, x - xmax, F.lit(0.0)), F.greatest(ymin - y, y - ymax, F.lit(0.0)))


def edges(polygons: DataFrame, rings: str) -> DataFrame:
    """The polygons' edges as rows with x0, y0, x1, y1 in a direction of their own, the lesser end first."""
    each = polygons.withColumn("ring", F.explode(rings)).withColumn("i", F.explode(F.sequence(F.lit(0), F.size("ring") - 1)))
    a, b = F.get("ring", F.col("i")), F.get("ring", (F.col("i") + 1) % F.size("ring"))
    low, high = F.least(a, b), F.greatest(a, b)
    return each.select(*[c for c in polygons.columns if c != rings], low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1"))


def bisect(boxes: DataFrame, xmin: str, ymin: str, xmax: str, ymax: str) -> DataFrame:
    """Two rows, half 0 and 1, for each box, cut across the middle of its longer side (of a square its width)."""
    wide = F.col(xmax) - F.col(xmin) >= F.col(ymax) - F.col(ymin)
    half = boxes.withColumn("half", F.explode(F.array(F.lit(0), F.lit(1)))).withColumns({"_x": (F.col(xmin) + F.col(xmax)) / 2, "_y": (F.col(ymin) + F.col(ymax)) / 2, "_wide": wide})
    cut = lambda own, mid, across, k: F.when(across & (F.col("half") == k), F.col(mid)).otherwise(F.col(own))
    w = F.col("_wide")
    return half.withColumns({xmin: cut(xmin, "_x", w, 1), ymin: cut(ymin, "_y", ~w, 1), xmax: cut(xmax, "_x", w, 0), ymax: cut(ymax, "_y", ~w, 0)}).drop("_x", "_y", "_wide")
