"""Grids of cells (r, c): regions with their outlines, contours, band boundaries, and polygons as cells.

Cell (r, c) is the square from (c, r) to (c + 1, r + 1) in x and y where areas count, and the point (c, r) where heights are
interpolated. Windows and neighbours meet by keys; lines and rings are put together by operators.planar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import geometry as M

from . import planar as P


def _edge(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(*[c.cast("double").alias(n) for c, n in zip((x0, y0, x1, y1), P.ENDS, strict=True)])


def cell_edges(cells: DataFrame, keys: list[str], r: str = "r", c: str = "c") -> DataFrame:
    """(keys, x0, y0, x1, y1): the four edges of every cell, the cell on their left."""
    x, y = F.col(c), F.col(r)
    four = F.array(_edge(x, y, x + 1, y), _edge(x + 1, y, x + 1, y + 1), _edge(x + 1, y + 1, x, y + 1), _edge(x, y + 1, x, y))
    return cells.select(*keys, F.explode(four).alias("e")).select(*keys, "e.*")


def regions(cells: DataFrame, keys: list[str], least: float = 0.0, r: str = "r", c: str = "c") -> DataFrame:
    """(keys, region, part, rings, area, holes): the areas of cells with equal keys that share sides, as polygons of least cells or more. region is a hash of
    the keys and the outline's least corner, so that it does not change with what else is on the grid."""
    out = P.nested(P.rings(P.outline(cell_edges(cells, keys, r, c), keys), keys), keys).where(F.col("area") >= least)
    first = F.get(F.get("rings", F.lit(0)), F.lit(0))
    name = F.substring(F.sha1(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], first["x"].cast("long").cast("string"), first["y"].cast("long").cast("string"))), 1, 12)
    return out.select(*keys, name.alias("region"), "part", "rings", "area", "holes")


def windows(grid: DataFrame, value: str, r: str = "r", c: str = "c") -> DataFrame:
    """(r, c, a, b, d, e): the values at the corners of each square of four neighbours, counter-clockwise from (r, c); squares with a missing one are none."""
    corner = F.array(*[F.struct((F.col(r) - dr).alias("r"), (F.col(c) - dc).alias("c"), F.lit(k).alias("k")) for k, (dr, dc) in enumerate(((0, 0), (0, 1), (1, 1), (1, 0)))])
    each = grid.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"), F.explode(corner).alias("w"))
    at = [F.max(F.when(F.col("w.k") == k, F.col("v"))).alias(n) for k, n in enumerate("abde")]
    return each.groupBy(F.col("w.r").alias("r"), F.col("w.c").alias("c")).agg(*at).where("a IS NOT NULL AND b IS NOT NULL AND d IS NOT NULL AND e IS NOT NULL")


def contour_segments(grid: DataFrame, value: str, step: float, without: float | None = None, r: str = "r", c: str = "c") -> DataFrame:
    """(level, x0, y0, x1, y1, start, end): contours at multiples of step (not at those of without) as segments across squares of four neighbours, the
    higher ground on their left. Ends are interpolated on the sides of the square; a value on the level is high. In a saddle the mean of the
    four decides: if it is high, the high corners are one ground. start and end name the sides, so that segments meet by them."""
    w = windows(grid, value, r, c)
    low, high = F.least("a", "b", "d", "e"), F.greatest("a", "b", "d", "e")
    n = F.explode(F.sequence(F.ceil(low / step), F.floor(high / step)))
    w = w.where(F.floor(high / step) >= F.ceil(low / step)).select("*", n.alias("n")).withColumn("level", F.col("n") * F.lit(float(step)))
    w = w if without is None else w.where(F.col("level") % F.lit(float(without)) != 0)
    a, b, d, e = (F.col(k) >= F.col("level") for k in "abde")
    x, y = F.col("c").cast("double"), F.col("r").cast("double")
    share = lambda p, q: (F.col("level") - F.col(p)) / F.when(F.col(p) != F.col(q), F.col(q) - F.col(p))
    name = lambda rr, cc, way: F.concat_ws(" ", rr.cast("string"), cc.cast("string"), F.lit(way))
    side = lambda px, py, key: F.struct(px.alias("x"), py.alias("y"), key.alias("side"))
    south, north = side(x + share("a", "b"), y, name(F.col("r"), F.col("c"), "h")), side(x + share("e", "d"), y + 1, name(F.col("r") + 1, F.col("c"), "h"))
    west, east = side(x, y + share("a", "e"), name(F.col("r"), F.col("c"), "v")), side(x + 1, y + share("b", "d"), name(F.col("r"), F.col("c") + 1, "v"))
    # Round the square from a: a segment begins where high turns low and ends where low turns high.
    begins = F.array_compact(F.array(F.when(a & ~b, south), F.when(b & ~d, east), F.when(d & ~e, north), F.when(e & ~a, west)))
    ends = F.array_compact(F.array(F.when(~a & b, south), F.when(~b & d, east), F.when(~d & e, north), F.when(~e & a, west)))
    w = w.withColumns({"_b": begins, "_e": ends, "_joint": (F.col("a") + F.col("b") + F.col("d") + F.col("e")) / 4 >= F.col("level")})
    # Of two segments each cuts off a low corner if the mean is high, else a high one: the end that follows the begin, or the one before it.
    first_low = F.when(a, 0).otherwise(1)
    turn = F.when(F.size("_b") < 2, 0).when(F.col("_joint"), first_low).otherwise(1 - first_low)
    pair = lambda k: F.struct(F.get("_b", F.lit(k)).alias("s"), F.get("_e", (F.lit(k) + turn) % F.size("_e")).alias("t"))
    each = w.where(F.size("_b") > 0).select("level", F.explode(F.array_compact(F.array(pair(0), F.when(F.size("_b") > 1, pair(1))))).alias("g"))
    return each.select("level", F.col("g.s.x").alias("x0"), F.col("g.s.y").alias("y0"), F.col("g.t.x").alias("x1"), F.col("g.t.y").alias("y1"), F.col("g.s.side").alias("start"), F.col("g.t.side").alias("end"))


def contours(grid: DataFrame, value: str, step: float, without: float | None = None, least: float = 0.0, r: str = "r", c: str = "c") -> DataFrame:
    """(level, line, points, length, closed): contour_segments as lines of that length or more; points that repeat the one before are left out."""
    found = P.lines(contour_segments(grid, value, step, without, r, c), ["level"], "start", "end").where(F.col("length") >= least)
    once = F.filter(F.transform("points", lambda p, i: F.when((i == 0) | (p != F.get("points", i - 1)), p)), lambda p: p.isNotNull())
    return found.withColumn("points", once)


def band_edges(cells: DataFrame, value: str, levels: list[float], r: str = "r", c: str = "c") -> DataFrame:
    """(level, x0, y0, x1, y1): for each level the sides between cells of at most that value and cells of more, the former on the left. Sides to
    cells that are not there, the coast, are none."""
    own = cells.where(F.col(value).isNotNull()).select(F.col(r).alias("r"), F.col(c).alias("c"), F.col(value).alias("v"))
    x, y = F.col("c"), F.col("r")
    right = own.join(own.select("r", (x - 1).alias("c"), F.col("v").alias("v2")), ["r", "c"]).select("v", "v2", _edge(x + 1, y, x + 1, y + 1).alias("up"))
    above = own.join(own.select((y - 1).alias("r"), "c", F.col("v").alias("v2")), ["r", "c"]).select("v", "v2", _edge(x + 1, y + 1, x, y + 1).alias("up"))
    each = right.unionByName(above).withColumn("level", F.explode(F.array(*[F.lit(float(v)) for v in levels]))).where("(v <= level) <> (v2 <= level)")
    e = F.when(F.col("v") <= F.col("level"), F.col("up")).otherwise(F.struct(F.col("up.x1").alias("x0"), F.col("up.y1").alias("y0"), F.col("up.x0").alias("x1"), F.col("up.y0").alias("y1")))
    return each.select("level", e.alias("e")).select("level", "e.*")


def band_boundaries(cells: DataFrame, value: str, levels: list[float], least: float = 0.0, r: str = "r", c: str = "c") -> DataFrame:
    """(level, line, points, length, closed): band_edges as lines of that length or more; a line ends at the coast and where two lines cross."""
    node = lambda a, b: F.concat_ws(" ", a, b)
    e = band_edges(cells, value, levels, r, c).withColumns({"start": node("x0", "y0"), "end": node("x1", "y1")})
    return P.lines(e, ["level"], "start", "end").where(F.col("length") >= least)


_SPANS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("r", "lo", "hi")]))


def spans(size: float):
    """An Arrow function from polygons to runs of cells (row r, columns lo to hi) of that size whose middles are inside: a scan line for each row of cells."""

    @F.arrow_udf(_SPANS)
    def run(rings: pa.Array) -> pa.Array:
        out = []
        for polygon in M.polygons_of(rings):
            found: list[dict] = []
            parts = [p for p in polygon or [] if len(p)]
            if parts:
                a = np.concatenate(parts)
                b = np.concatenate([np.roll(p, -1, 0) for p in parts])
                rows = np.arange(np.floor(a[:, 1].min() / size), np.floor(a[:, 1].max() / size) + 1)
                for r in rows.astype(np.int64).tolist():
                    y = (r + 0.5) * size
                    on = (a[:, 1] <= y) != (b[:, 1] <= y)
                    x = np.sort(a[on, 0] + (y - a[on, 1]) / (b[on, 1] - a[on, 1]) * (b[on, 0] - a[on, 0]))
                    lo, hi = np.ceil(x[0::2] / size - 0.5), np.ceil(x[1::2] / size - 0.5) - 1
                    found += [{"r": r, "lo": int(i), "hi": int(j)} for i, j in zip(lo, hi, strict=True) if i <= j]
            out.append(found)
        return pa.array(out, pa.list_(pa.struct([(n, pa.int64()) for n in ("r", "lo", "hi")])))

    return run


def polygon_cells(polygons: DataFrame, rings: str, size: float) -> DataFrame:
    """polygons without rings, a row for each cell (r, c) of that size whose middle is in one."""
    runs = polygons.withColumn("_run", F.explode(spans(size)(rings)))
    return runs.select(*[c for c in polygons.columns if c != rings], F.col("_run.r").alias("r"), F.explode(F.sequence("_run.lo", "_run.hi")).alias("c"))


def gap_fragments(shells: DataFrame, details: DataFrame, group: str, rings: str, size: float, least: float = 0.0) -> DataFrame:
    """(group, fragment, rings, area, holes): what details (group, rings) leave open of the shells (group, rings) of their group, on cells of that size, as
    polygons of at least that area. Cells that share sides are one fragment."""
    shell = polygon_cells(shells.select(group, rings), rings, size).distinct()
    open_cells = shell.join(polygon_cells(details.select(group, rings), rings, size), [group, "r", "c"], "left_anti")
    found = regions(open_cells, [group]).withColumnRenamed("region", "fragment")
    wide = lambda p: F.struct((p["x"] * size).alias("x"), (p["y"] * size).alias("y"))
    out = found.withColumns({"rings": F.transform("rings", lambda r: F.transform(r, wide)), "area": F.col("area") * size * size})
    return out.where(F.col("area") >= least).select(group, "fragment", "rings", "area", "holes")
