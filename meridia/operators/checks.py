"""Data checks as tables of what fails: aggregates, anti-joins and counts that combine before the shuffle."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_report(rows: DataFrame, key: str, blanks: dict[str, Column]) -> DataFrame:
    """One row: n, duplicate_keys (rows beyond the first of their key), null_keys, and for each of blanks the rows where it is null or blank."""
    blank = {name: F.count_if(c.isNull() | (F.trim(c) == "")) for name, c in blanks.items()}
    per = rows.groupBy(key).agg(F.count(F.lit(1)).alias("k"), *[c.alias(name) for name, c in blank.items()])
    none = F.sum(F.when(F.col(key).isNull(), F.col("k")).otherwise(0))
    return per.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), (F.coalesce(F.sum("k"), F.lit(0)) - F.count(F.lit(1))).alias("duplicate_keys"), none.alias("null_keys"), *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in blanks])


def regression(baseline: DataFrame, candidate: DataFrame, key: str, metrics: dict[str, Column], tolerance: dict[str, Column]) -> DataFrame:
    """For each key of the baseline and each metric (an aggregate of both tables): before, after (0 if the key is gone), and ok if no
    more is lost than the tolerance, a column that may use before."""
    one = lambda t, side: t.groupBy(key).agg(*[c.cast("double").alias(f"{side}_{m}") for m, c in metrics.items()])
    both = one(baseline, "b").join(one(candidate, "c"), key, "left")
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"b_{m}").alias("before"), F.coalesce(f"c_{m}", F.lit(0.0)).alias("after")) for m in metrics]))
    allowed = reduce(lambda a, m: a.when(F.col("metric") == m, tolerance[m]), list(metrics), F.when(F.lit(False), F.lit(0.0)))
    return both.select(key, each.alias("m")).select(key, "m.*").withColumn("ok", F.col("before") - F.col("after") <= allowed)


def assertions(facts: DataFrame, expected: DataFrame) -> DataFrame:
    """(rule, value, ok) for rules (rule, fact, op, bound) over one row of facts: op is equals, min, max or forbidden (the fact must be 0). A
    fact that is not there fails."""
    known = facts.select(*[F.col(c).cast("double").alias(c) for c in facts.columns]).unpivot([], facts.columns, "fact", "value")
    met = F.when(F.col("op") == "equals", F.col("value") == F.col("bound")).when(F.col("op") == "min", F.col("value") >= F.col("bound")).when(F.col("op") == "max", F.col("value") <= F.col("bound")).when(F.col("op") == "forbidden", F.col("value") == 0)
    return expected.join(F.broadcast(known), "fact", "left").select("rule", "value", F.coalesce(met, F.lit(False)).alias("ok"))  # facts are as many as columns


def group_check(rows: DataFrame, group: str, wrong: Column, culprit: Column | None = None) -> DataFrame:
    """For each group: n, wrong (rows where the test is true) and pass; with culprit also up to ten of its least values among the wrong."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("wrong")).withColumn("pass", F.col("wrong") == 0)
    if culprit is None:
        return out
    seen = rows.where(wrong).select(group, culprit.cast("string").alias("v")).distinct()
    top = seen.withColumn("nth", F.expr(f"row_number() OVER (PARTITION BY {group} ORDER BY v)")).where("nth <= 10").groupBy(group).agg(F.sort_array(F.collect_list("v")).alias("culprits"))
    return out.join(top, group, "left")


def not_covered_once(leaves: DataFrame, key: str, groups: DataFrame, group: str) -> DataFrame:
    """(key, groups): leaves that are in no group or in several; a group that names a leaf twice counts once."""
    n = groups.select(key, group).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("groups"))
    return leaves.select(key).distinct().join(n, key, "left").select(key, F.coalesce("groups", F.lit(0)).alias("groups")).where("groups <> 1")


def used_but_unknown(used: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """One row: used keys and those that are not known; null keys do not count."""
    have = known.select(key).distinct().withColumn("_known", F.lit(True))
    return used.select(key).where(F.col(key).isNotNull()).distinct().join(have, key, "left").agg(F.count(F.lit(1)).alias("used"), F.count_if(F.col("_known").isNull()).alias("missing"))


def health(rows: DataFrame, group: str, actual: Column, ratio: float, drop: int) -> DataFrame:
    """For each group actual (rows where the test is true), expected (all) and error: the ratio is less and the drop at least so much."""
    n = rows.groupBy(group).agg(F.count_if(actual).alias("actual"), F.count(F.lit(1)).alias("expected"))
    return n.withColumn("error", (F.col("actual") / F.col("expected") < ratio) & (F.col("expected") - F.col("actual") >= drop))


def drift(source: DataFrame, runtime: DataFrame, key: str, in_source: str, in_runtime: str) -> DataFrame:
    """(key, in_source, in_runtime): each key of either table once, and which of them has it."""
    a, b = source.select(key).distinct().withColumn(in_source, F.lit(True)), runtime.select(key).distinct().withColumn(in_runtime, F.lit(True))
    return a.join(b, key, "full_outer").select(key, F.coalesce(in_source, F.lit(False)).alias(in_source), F.coalesce(in_runtime, F.lit(False)).alias(in_runtime))
