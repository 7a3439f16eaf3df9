"""Parts of polygons: culling small ones, halving large ones until there are enough."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as M
from meridia.sources.shared import scratch

from . import spatial as G
from .selection import numbered


def cull_parts(features: DataFrame, key: str, group: str, parts: str, least: float, points: DataFrame | None = None, lon: str = "lon", lat: str = "lat", size: Callable[[Column], Column] = M.area) -> DataFrame:
    """features with those of their parts (an array of polygons) that stay: of that size or more, or of the largest of their group, or that hold a protected
    point. Features without any part left are gone; if none would be left at all, all stay as they are. key is unique."""
    each = features.select(key, group, F.posexplode(parts).alias("_at", "_rings")).withColumn("_area", size(F.col("_rings")))
    each = scratch(each.withColumn("_part", F.monotonically_increasing_id()), "parts")
    top = each.groupBy(group).agg(F.max("_area").alias("_top"))
    held = None if points is None else G.within(points.select(lon, lat), each.select("_part", "_rings"), "_rings", lon, lat, "_part").select("_part").distinct().withColumn("_held", F.lit(True))
    both = each.join(top, each[group].eqNullSafe(top[group])).drop(top[group])
    both = both.withColumn("_held", F.lit(None).cast("boolean")) if held is None else both.join(held, "_part", "left")
    kept = scratch(both.where((F.col("_area") >= least) | (F.col("_area") == F.col("_top")) | F.col("_held")).select(key, "_at", "_rings"), "kept-parts")
    if kept.isEmpty():
        return features
    again = kept.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_at", "_rings")))["_rings"].alias(parts))
    return features.drop(parts).join(again, key).select(*features.columns)


def halves(polygons: DataFrame, rings: str) -> DataFrame:
    """Two rows, half 0 and 1, for each polygon, cut across the middle of the longer side of its box (of a square its width)."""
    box = ("_x0", "_y0", "_x1", "_y1")
    cut = G.bisect(polygons.withColumns(dict(zip(box, G.bounds(F.col(rings)), strict=True))), *box)
    return cut.withColumn(rings, M.clip_rings(F.col(rings), F.get(G.box_rings(*box), F.lit(0)))).drop(*box)


def bisect_to(polygons: DataFrame, key: str, rings: str, target: int) -> DataFrame:
    """(key, path, rings, area): the polygons, of which the largest is halved (halves) until there are target of them; path has a 0 or 1 for each cut.
    Of equal ones (to nine digits) the one that is cut less goes first, then that of the least key and path. Polygons without area are not cut.

    No half is larger than the whole, so what is cut are the target - n largest of all polygons and possible halves. A round halves all
    that rank so high among those known by then, until they are all cut; rounds grow with the depth of cuts, not their number.
    """
    at = lambda df: df.select(key, "path", rings, "area", F.length("path").alias("depth"))
    known = scratch(at(polygons.select(key, F.lit("").alias("path"), rings).withColumn("area", M.area(F.col(rings)))), "halves")
    cuts = target - known.count()
    done = None
    while cuts > 0:
        ranked = numbered(known.where("area > 0").select(key, "path", "area", "depth"), [-F.round("area", 9), F.col("depth"), F.col(key), F.col("path")], "_n")
        chosen = scratch(ranked.where(F.col("_n") < cuts).select(key, "path"), "chosen")
        fresh = chosen if done is None else chosen.join(done, [key, "path"], "left_anti")
        new = halves(known.join(fresh, [key, "path"], "left_semi"), rings).withColumn("path", F.concat("path", F.col("half").cast("string")))
        new = scratch(at(new.drop("half").withColumn("area", M.area(F.col(rings)))), "halves")
        if new.isEmpty():
            # What is left: neither cut itself nor below one that is not.
            mark = chosen.select(F.col(key).alias("_k"), F.col("path").alias("_p"))
            leaf = known.join(chosen, [key, "path"], "left_anti").withColumn("_up", F.when(F.col("depth") > 0, F.expr("substring(path, 1, depth - 1)")))
            below = leaf.where("_up IS NOT NULL").join(mark, (F.col(key) == F.col("_k")) & (F.col("_up") == F.col("_p")), "left_semi")
            return leaf.where("_up IS NULL").unionByName(below).select(key, "path", rings, "area")
        done = scratch(fresh if done is None else done.unionByName(fresh), "cut")
        known = scratch(known.unionByName(new), "known-halves")
    return known.select(key, "path", rings, "area")
