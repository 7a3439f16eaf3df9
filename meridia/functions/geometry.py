"""Geometry of rings (arrays of points x, y; not closed) and of polygons (arrays of rings, holes wound either way).

Sums along a ring are column expressions; clipping and simplification, which columns cannot say, are Arrow functions over
whole batches. Units are those of the coordinates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = "array<struct<x:double,y:double>>"
_POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def _around(ring: Column, zero: Column, step) -> Column:
    """Folds step(sum, a, b) over the ring's edges."""
    n = F.size(ring)
    return F.aggregate(F.sequence(F.lit(0), n - 1), zero, lambda acc, i: step(acc, F.get(ring, i), F.get(ring, (i + 1) % n)))


def signed_area(ring: Column) -> Column:
    """Positive if the ring runs counter-clockwise."""
    return _around(ring, F.lit(0.0), lambda acc, a, b: acc + (a["x"] * b["y"] - b["x"] * a["y"]) / 2)


def rewind(ring: Column) -> Column:
    """The ring counter-clockwise."""
    return F.when(signed_area(ring) < 0, F.reverse(ring)).otherwise(ring)


def area(rings: Column) -> Column:
    """The first ring's area without those of the others."""
    holes = F.aggregate(F.slice(rings, 2, 1 << 20), F.lit(0.0), lambda acc, r: acc + F.abs(signed_area(r)))
    return F.abs(signed_area(F.get(rings, F.lit(0)))) - holes


def centroid(ring: Column) -> Column:
    """Area centroid (x, y); of a ring without area, the mean of its points."""
    zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def step(acc: Column, a: Column, b: Column) -> Column:
        c = a["x"] * b["y"] - b["x"] * a["y"]
        return F.struct((acc["a"] + c).alias("a"), (acc["x"] + (a["x"] + b["x"]) * c).alias("x"), (acc["y"] + (a["y"] + b["y"]) * c).alias("y"))

    s = _around(ring, zero, step)
    mean = lambda k: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + p[k]) / F.size(ring)
    at = lambda k: F.coalesce(F.try_divide(s[k], 3 * s["a"]), mean(k))
    return F.struct(at("x").alias("x"), at("y").alias("y"))


def line_length(line: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.size(line) - 1), F.lit(0.0), lambda acc, i: acc + F.hypot(F.get(line, i)["x"] - F.get(line, i - 1)["x"], F.get(line, i)["y"] - F.get(line, i - 1)["y"]))


def circle(x: Column, y: Column, radius: Column, sides: int = 16) -> Column:
    """A regular polygon's ring around a point."""
    angle = lambda i: i * (2 * np.pi / sides)
    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), lambda i: F.struct((x + radius * F.cos(angle(i))).alias("x"), (y + radius * F.sin(angle(i))).alias("y")))


def circle_metres(lon: Column, lat: Column, metres: Column, sides: int = 16) -> Column:
    """A ring of points that are all so many metres from a point of the globe, counter-clockwise from the east. Longitudes run on past the date line."""
    d, y = metres / 6_371_008.8, F.radians(lat)

    def corner(i: Column) -> Column:
        turn = i * (2 * np.pi / sides)
        up = F.asin(F.sin(y) * F.cos(d) + F.cos(y) * F.sin(d) * F.sin(turn))
        east = F.atan2(F.cos(turn) * F.sin(d) * F.cos(y), F.cos(d) - F.sin(y) * F.sin(up))
        return F.struct((lon + F.degrees(east)).alias("x"), F.degrees(up).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(sides - 1)), corner)


def clip(p: np.ndarray, n: np.ndarray, start: np.ndarray, direction: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Many convex polygons at once, (polygons, corners, 2) with n corners each, cut to the left of a line each; a cut adds one corner at most."""
    i = np.arange(p.shape[1])
    inside = i < n[:, None]
    side = direction[:, None, 0] * (p[..., 1] - start[:, None, 1]) - direction[:, None, 1] * (p[..., 0] - start[:, None, 0])
    following = np.where(i + 1 < n[:, None], i + 1, 0)
    q, t = np.take_along_axis(p, following[..., None], 1), np.take_along_axis(side, following, 1)
    keep, cross = inside & (side >= 0), inside & ((side >= 0) != (t >= 0))
    at = np.cumsum(keep.astype(int) + cross, 1) - keep - cross
    out = np.zeros((len(p), p.shape[1] + 1, 2))
    out[np.nonzero(keep)[0], at[keep]] = p[keep]
    share = (side[cross] / (side[cross] - t[cross]))[:, None]
    out[np.nonzero(cross)[0], (at + keep)[cross]] = p[cross] + (q[cross] - p[cross]) * share
    return out, keep.sum(1) + cross.sum(1)


def shoelace(p: np.ndarray) -> np.ndarray:
    """Signed areas of rings (..., corners, 2)."""
    q = np.roll(p, -1, -2)
    return (p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(-1) / 2


def fans(rings: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(signs, counter-clockwise triangles) whose indicator functions add up to the polygon's: outer rings count positive, holes negative."""
    out = [np.zeros((0, 3, 2))]
    for k, ring in enumerate(rings):
        p = ring
        if len(p) > 2:
            p = p if (shoelace(p) >= 0) == (k == 0) else p[::-1]
            out.append(np.stack((np.broadcast_to(p[0], (len(p) - 2, 2)), p[1:-1], p[2:]), 1))
    t = np.concatenate(out)
    size = shoelace(t)
    t, sign = t[size != 0], np.sign(size[size != 0])
    return sign, np.where(sign[:, None, None] > 0, t, t[:, ::-1])


def shared_areas(a: list, b: list, at_once: int = 1 << 16) -> np.ndarray:
    """Area that two polygons have in common, row by row, by their fans: sum of s * t * area(T and U). Works for holes and concave rings.
    The triangles of all rows are clipped together, so many pairs at a time."""
    one, two = [fans(x) for x in a], [fans(x) for x in b]
    total = np.zeros(len(a))
    pending: list[tuple] = []

    def settle() -> None:
        row, sign, t, u = (np.concatenate(x) for x in zip(*pending, strict=True))
        p, n = t, np.full(len(t), 3)
        for k in range(3):
            p, n = clip(p, n, u[:, k], u[:, (k + 1) % 3] - u[:, k])
        # Unused corners repeat the first, which adds no area.
        p = np.where((np.arange(p.shape[1]) < n[:, None])[..., None], p, p[:, :1])
        np.add.at(total, row, sign * np.where(n > 2, shoelace(p), 0.0))
        pending.clear()

    size = 0
    for row, ((s, t), (z, u)) in enumerate(zip(one, two, strict=True)):
        for k in range(0, len(t), 256):
            lo, hi = t[k : k + 256].min(1), t[k : k + 256].max(1)
            i, j = np.nonzero((u.min(1)[None] < hi[:, None]).all(2) & (u.max(1)[None] > lo[:, None]).all(2))
            pending.append((np.full(len(i), row), s[k + i] * z[j], t[k + i], u[j]))
            size += len(i)
            if size >= at_once:
                settle()
                size = 0
    if pending:
        settle()
    return total


def polygons_of(column: pa.Array) -> list[list[np.ndarray] | None]:
    """An Arrow column of polygons as rings of (corners, 2), null where it is null; views of its buffers, whatever sizes rings have."""
    inner = column.values
    xy = np.column_stack([inner.values.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")])
    outer, at = column.offsets.to_numpy(), inner.offsets.to_numpy()
    known = column.is_valid().to_numpy(zero_copy_only=False)
    return [[xy[at[i] : at[i + 1]] for i in range(outer[k], outer[k + 1])] if known[k] else None for k in range(len(column))]


def rings_of(column: pa.Array) -> list[np.ndarray | None]:
    """The like for a column of rings."""
    xy = np.column_stack([column.values.field(k).to_numpy(zero_copy_only=False) for k in ("x", "y")])
    at, known = column.offsets.to_numpy(), column.is_valid().to_numpy(zero_copy_only=False)
    return [xy[at[k] : at[k + 1]] if known[k] else None for k in range(len(column))]


def to_polygons(found: list[list[np.ndarray] | None]) -> pa.Array:
    flat = [p for rings in found if rings is not None for p in rings]
    xy = np.concatenate([np.zeros((0, 2)), *flat])
    points = pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], names=["x", "y"])
    rings = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, flat)]), pa.int32()), points)
    ends = np.cumsum([0, *(len(r) if r is not None else 0 for r in found)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rings, mask=pa.array([r is None for r in found], pa.bool_()))


@F.arrow_udf(T.DoubleType())
def overlap_area(a: pa.Array, b: pa.Array) -> pa.Array:
    """shared_areas by rows; null if either is null."""
    pairs = list(zip(polygons_of(a), polygons_of(b), strict=True))
    known = [x is not None and y is not None for x, y in pairs]
    found = iter(shared_areas([x for (x, _), k in zip(pairs, known, strict=True) if k], [y for (_, y), k in zip(pairs, known, strict=True) if k]))
    return pa.array([float(next(found)) if k else None for k in known], pa.float64())


def clip_ring(p: np.ndarray, window: np.ndarray) -> np.ndarray:
    """A ring (corners, 2), convex or not, cut to a convex counter-clockwise window edge by edge. What falls apart stays one ring, its pieces tied along the
    window's border, so that the area is exact."""
    for a, b in zip(window, np.roll(window, -1, 0), strict=True):
        if not len(p):
            break
        d = b - a
        side = d[0] * (p[:, 1] - a[1]) - d[1] * (p[:, 0] - a[0])
        q, t = np.roll(p, -1, 0), np.roll(side, -1)
        keep, cross = side >= 0, (side >= 0) != (t >= 0)
        at = np.zeros(len(p))
        at[cross] = side[cross] / (side[cross] - t[cross])
        both = np.stack((p, p + (q - p) * at[:, None]), 1).reshape(-1, 2)
        p = both[np.stack((keep, cross), 1).ravel()]
    if len(p):
        p = p[(p != np.roll(p, 1, 0)).any(1)]
    return p


@F.arrow_udf(T.ArrayType(T.ArrayType(_POINT)))
def clip_rings(rings: pa.Array, window: pa.Array) -> pa.Array:
    """The polygon's part in a convex window (a ring, wound either way); no rings if nothing is in it, null if either is null. Holes that nothing of is in the window are gone."""
    out: list[list[np.ndarray] | None] = []
    for r, w in zip(polygons_of(rings), rings_of(window), strict=True):
        if r is None or w is None:
            out.append(None)
            continue
        w = w if shoelace(w) >= 0 else w[::-1]
        cut = [clip_ring(p, w) for p in r]
        whole = len(cut) > 0 and len(cut[0]) > 2 and shoelace(cut[0]) != 0
        out.append([p for p in cut if len(p) > 2 and shoelace(p) != 0] if whole else [])
    return to_polygons(out)


def inside_point(rings: list[np.ndarray]) -> tuple[float, float] | None:
    """The middle of the widest stretch inside the polygon on a line across the middle of its height, between the heights of its corners. Of
    equal stretches (to nine digits) the westmost; without any area the first corner."""
    rings = [r for r in rings if len(r)]
    if not rings:
        return None
    heights = np.unique(np.concatenate(rings)[:, 1])
    if len(heights) > 1:
        k = int(np.clip(np.searchsorted(heights, (heights[0] + heights[-1]) / 2, "right"), 1, len(heights) - 1))
        y = (heights[k - 1] + heights[k]) / 2
        xs = []
        for p in rings:
            q = np.roll(p, -1, 0)
            on = (p[:, 1] <= y) != (q[:, 1] <= y)
            xs.append(p[on, 0] + (y - p[on, 1]) / (q[on, 1] - p[on, 1]) * (q[on, 0] - p[on, 0]))
        x = np.sort(np.concatenate(xs))
        if len(x) > 1:
            n = len(x) // 2 * 2
            wide = x[1:n:2] - x[0:n:2]
            k = 2 * int(np.round(wide, 9).argmax())
            return float((x[k] + x[k + 1]) / 2), float(y)
    return float(rings[0][0, 0]), float(rings[0][0, 1])


@F.arrow_udf(_POINT)
def inner_point(rings: pa.Array) -> pa.Array:
    """A point inside the polygon: see inside_point. Null if there are no corners."""
    found = [None if r is None else inside_point(r) for r in polygons_of(rings)]
    return pa.array([{"x": f[0], "y": f[1]} if f else None for f in found], pa.struct([("x", pa.float64()), ("y", pa.float64())]))


def douglas_peucker(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Mask of the points that stay, ends always; a point goes if it is within the tolerance of the chord that replaces it."""
    keep = np.zeros(len(p), bool)
    keep[[0, -1]] = True
    spans = [(0, len(p) - 1)]
    while spans:
        i, j = spans.pop()
        if j - i < 2:
            continue
        a, d, q = p[i], p[j] - p[i], p[i + 1 : j]
        n = np.hypot(*d)
        far = np.abs(d[0] * (q[:, 1] - a[1]) - d[1] * (q[:, 0] - a[0])) / n if n else np.hypot(*(q - a).T)
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            spans += [(i, i + 1 + k), (i + 1 + k, j)]
    return keep


def simplify(tolerance: float, degrees: bool = False):
    """An Arrow function from lines to simplified lines. degrees: points are longitudes and latitudes and the tolerance is metres, on a plane
    that touches the globe at the line's mean latitude."""

    @F.pandas_udf(POINTS)
    def run(lines: pd.Series) -> pd.Series:
        out = []
        for line in lines:
            if line is None or len(line) < 3:
                out.append(line)
                continue
            p = np.array([(q["x"], q["y"]) for q in line], float)
            if degrees:
                p = p * (np.pi / 180 * 6_371_008.8) * np.array([np.cos(np.radians(p[:, 1].mean())), 1.0])
            out.append([q for q, k in zip(line, douglas_peucker(p, tolerance), strict=True) if k])
        return pd.Series(out)

    return run
