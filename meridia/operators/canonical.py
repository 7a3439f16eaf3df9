"""Boundaries on a common grid: corners snap, what collapses or leaves the shell is told, and a country changes as a whole or not at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions import geometry as M
from meridia.sources.shared import scratch


def snapped(rings: Column, step: float) -> Column:
    """Rings with corners on a grid of that step; corners that fall on the one before are left out, rings of less than three are none."""
    snap = lambda c: F.round(c / step) * step + 0.0
    moved = F.transform(rings, lambda r: F.transform(r, lambda p: F.struct(snap(p["x"]).alias("x"), snap(p["y"]).alias("y"))))
    before = lambda r, i: F.get(r, F.when(i == 0, F.size(r) - 1).otherwise(i - 1))
    once = F.transform(moved, lambda r: F.filter(r, lambda p, i: p != before(r, i)))
    return F.filter(once, lambda r: F.size(r) > 2)


def canonicalise(features: DataFrame, country: str, id_col: str, rings: str, step: float, shell: Column | None = None) -> DataFrame:
    """features with a reason: of a country whose ids are the same before and after, each once, all rings are snapped (and cut to the shell, a convex ring):
    "canonical". Other countries keep their rings: "lost k" or "repeated k" tells of how many ids. A polygon is lost without any area."""
    # Written, as an Arrow function cannot take what lambdas make, and the rings are read twice.
    both = scratch(features.withColumn("_new", snapped(F.col(rings), step)), "snapped")
    both = both if shell is None else scratch(both.withColumn("_new", M.clip_rings("_new", shell)), "clipped")
    stays = F.coalesce((F.size("_new") > 0) & (M.area(F.when(F.size("_new") > 0, F.col("_new"))) > 0), F.lit(False))
    ids = both.select(country, id_col, stays.alias("_stays")).groupBy(country, id_col).agg(F.count(F.lit(1)).alias("n"), F.max("_stays").alias("stays"))
    told = ids.groupBy(country).agg(F.count_if(~F.col("stays")).alias("lost"), F.count_if(F.col("n") > 1).alias("again"))
    reason = F.when(F.col("lost") > 0, F.concat(F.lit("lost "), "lost")).when(F.col("again") > 0, F.concat(F.lit("repeated "), "again")).otherwise("canonical")
    told = told.select(F.col(country).alias("_country"), reason.alias("reason"))
    out = both.join(told, F.col(country).eqNullSafe(F.col("_country")))
    return out.withColumn(rings, F.when(F.col("reason") == "canonical", F.col("_new")).otherwise(F.col(rings))).select(*features.columns, "reason")
