"""Edit logs: layered upserts, tombstones and the state after a log, as aggregates over (key, seq, value) rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, key: str, seq: str, value: str) -> DataFrame:
    """(key, value) after the log: each key's last value, a null value removes the key. Ties of seq: the greater value."""
    last = log.groupBy(key).agg(F.max(F.struct(F.col(seq).alias("s"), F.col(value).alias("v")))["v"].alias(value))
    return last.where(F.col(value).isNotNull())


def layered(layers: list[DataFrame], key: str, value: str, layer: str = "layer") -> DataFrame:
    """(key, value, layer): the value of the last layer that has the key, and that layer's number. One shuffle for all layers."""
    rows = [x.select(F.col(key), F.col(value), F.lit(k).alias(layer)) for k, x in enumerate(layers)]
    both = reduce(lambda a, b: a.unionByName(b), rows)
    return both.groupBy(key).agg(F.max(F.struct(layer, value)).alias("m")).select(key, F.col(f"m.{value}"), F.col(f"m.{layer}"))


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """(key, old, new, change) of keys that were added, removed or changed."""
    a, b = old.select(key, F.col(value).alias("old"), F.lit(True).alias("in_old")), new.select(key, F.col(value).alias("new"), F.lit(True).alias("in_new"))
    both = a.join(b, key, "full_outer")
    change = F.when(F.col("in_old").isNull(), "added").when(F.col("in_new").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "changed")
    return both.withColumn("change", change).where("change IS NOT NULL").select(key, "old", "new", "change")


def with_replacements(base: DataFrame, over: DataFrame, key: str, replaces: str) -> DataFrame:
    """base without the rows whose key an override names in its array replaces or has itself, then the overrides; source tells which. Columns are those of over but replaces."""
    own = [c for c in over.columns if c != replaces]
    gone = over.select(F.explode(F.array_union(F.coalesce(replaces, F.array().cast(over.schema[replaces].dataType)), F.array(key))).alias(key)).distinct()
    kept = base.join(gone, key, "left_anti").select(*own).withColumn("source", F.lit("base"))
    return kept.unionByName(over.select(*own).withColumn("source", F.lit("override")))


def apply_log(base: DataFrame, log: DataFrame, key: str, seq: str, value: str, into: str) -> DataFrame:
    """base with into set by the log's last value of its key, where that is not null, and touched."""
    last = log.groupBy(key).agg(F.max(F.struct(seq, value))[value].alias("_value"), F.lit(True).alias("touched"))
    return base.join(last, key, "left").withColumn(into, F.coalesce("_value", into)).withColumn("touched", F.coalesce("touched", F.lit(False))).drop("_value")


def unknown_keys(log: DataFrame, base: DataFrame, key: str) -> DataFrame:
    """Rows of the log whose key the base does not have."""
    return log.join(base.select(key), key, "left_anti")


def override_status(overrides: DataFrame, known: DataFrame, key: str, value: str) -> DataFrame:
    """(key, status): conflict if the key is given different values, unknown if no row has it, else ok."""
    n = overrides.groupBy(key).agg(F.countDistinct(value).alias("n"))
    have = known.select(key).distinct().withColumn("_known", F.lit(True))
    return n.join(have, key, "left").select(key, F.when(F.col("n") > 1, "conflict").when(F.col("_known").isNull(), "unknown").otherwise("ok").alias("status"))


def first_known(steps: list[tuple[str, Column]]) -> Column:
    """(value, source) of the first step whose column is not null; null if all are."""
    return F.coalesce(*[F.when(c.isNotNull(), F.struct(c.alias("value"), F.lit(name).alias("source"))) for name, c in steps])
