"""Rules as tables: selectors to features, ordered assignment with fallbacks, rule packs, mapping by sources, and what is amiss.

Selectors are rows (rule_id, exclude, kind, value), members rows (kind, value, id): a feature's country, group, id or any
other kind of key that it has. All matching is one equi-join of these and one aggregate, whatever the number of rules. Where only the
last rule of a feature counts, or whether a rule has a target at all, no row is made for each rule and target.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def selectors(rules: DataFrame, kinds: dict[str, tuple[str, str]]) -> DataFrame:
    """Rules with array columns to selector rows; kinds: kind to its columns of included and excluded values. Null arrays select nothing."""
    parts = [rules.select("rule_id", F.lit(k == 1).alias("exclude"), F.lit(kind).alias("kind"), F.explode(F.col(c).cast("array<string>")).alias("value")) for kind, pair in kinds.items() for k, c in enumerate(pair)]
    return reduce(DataFrame.unionByName, parts).where("trim(value) <> ''").distinct()


def members(features: DataFrame, id_col: str, kinds: dict[str, Column]) -> DataFrame:
    """(kind, value, id) of the features, a row for each of their keys; a null key belongs to nothing."""
    keys = F.array(*[F.struct(F.lit(k).alias("kind"), c.cast("string").alias("value")) for k, c in kinds.items()])
    return features.select(F.col(id_col).alias("id"), F.inline(keys)).where("value IS NOT NULL").select("kind", "value", "id")


def prefix_members(features: DataFrame, id_col: str, text: Column, chosen: DataFrame) -> DataFrame:
    """(kind prefix, value, id): of each feature's text the beginnings that are as long as some prefix selector, so that prefixes
    are an equi-join too. The lengths are one row of at most as many numbers as the longest prefix has letters."""
    lengths = chosen.where("kind = 'prefix'").agg(F.collect_set(F.length("value")).alias("lengths"))
    each = features.select(F.col(id_col).alias("id"), text.alias("t")).crossJoin(F.broadcast(lengths))
    return each.select(F.lit("prefix").alias("kind"), F.explode(F.transform("lengths", lambda n: F.substring("t", 1, n))).alias("value"), "id").where("t IS NOT NULL").distinct()


def targets(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """(rule_id, id): what the rules include and do not exclude."""
    hits = chosen.join(known, ["kind", "value"]).groupBy("rule_id", "id").agg(F.bool_or("exclude").alias("out"))
    return hits.where("NOT out").select("rule_id", "id")


def excluded(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """(rule_id, id): what the rules exclude."""
    # Members are a row for each key of a feature, which the size of the features' table does not tell: never a broadcast.
    return known.hint("merge").join(chosen.where("exclude"), ["kind", "value"]).select("rule_id", "id").distinct()


def last_targets(rules: DataFrame, chosen: DataFrame, known: DataFrame) -> DataFrame:
    """(rule_id, id): of targets the last in the order of priority and rule_id for each id. A feature that n rules exclude has it among the n + 1 last rules
    of each of its keys, so rows grow with the features and what is excluded, not with all that rules select."""
    out = excluded(chosen, known)
    order = rules.groupBy("rule_id").agg(F.max("priority").alias("priority"))
    last = Window.partitionBy("kind", "value").orderBy(F.desc("priority"), F.desc("rule_id"))
    ranked = chosen.where("NOT exclude").join(order, "rule_id").withColumn("_nth", F.row_number().over(last)).select("kind", "value", "_nth", "rule_id", "priority")
    lost = out.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("_lost"))
    seen = known.hint("merge").join(lost, "id", "left").withColumn("_nth", F.explode(F.sequence(F.lit(1), F.coalesce("_lost", F.lit(0)) + 1)))
    hits = seen.hint("merge").join(ranked, ["kind", "value", "_nth"]).select("rule_id", "id", "priority").join(out, ["rule_id", "id"], "left_anti")
    return hits.groupBy("id").agg(F.max(F.struct("priority", "rule_id"))["rule_id"].alias("rule_id")).select("rule_id", "id")


def with_target(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """(rule_id): rules of targets, each once: those with a selector whose key has more members than the rule excludes of them."""
    include = chosen.where("NOT exclude").select("rule_id", "kind", "value")
    lost = excluded(chosen, known).join(known.hint("merge"), "id").join(include, ["rule_id", "kind", "value"]).groupBy("rule_id", "kind", "value").agg(F.count(F.lit(1)).alias("_lost"))
    n = known.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("_n"))
    return include.join(n, ["kind", "value"]).join(lost, ["rule_id", "kind", "value"], "left").where("_n > coalesce(_lost, 0)").select("rule_id").distinct()


def missing(chosen: DataFrame, known: DataFrame) -> DataFrame:
    """Selectors that no feature has."""
    return chosen.join(known.select("kind", "value").distinct(), ["kind", "value"], "left_anti").select("rule_id", "kind", "value", "exclude")


def empty(rules: DataFrame, hit: DataFrame) -> DataFrame:
    """Rules without any target; hit: targets or with_target."""
    return rules.select("rule_id").distinct().join(hit.select("rule_id").distinct(), "rule_id", "left_anti")


def last_rule(rules: DataFrame, hit: DataFrame, values: list[str]) -> DataFrame:
    """(id, rule_id, values): for each target the last rule in the order of priority and id. Rules are the small side of the join, but need not be."""
    won = hit.join(rules.select("rule_id", "priority", *values), "rule_id").groupBy("id").agg(F.max(F.struct("priority", "rule_id", *values)).alias("r"))
    return won.select("id", "r.rule_id", *[f"r.{v}" for v in values])


def assign(features: DataFrame, id_col: str, rules: DataFrame, hit: DataFrame, direct: Column, fallbacks: dict[str, Column]) -> DataFrame:
    """(id, tag, source), hit being targets or last_targets: the last rule's tag; else the direct one; else the first fallback that has one, which names the source."""
    ladder = F.coalesce(
        F.when(F.col("rule_tag").isNotNull(), F.struct(F.col("rule_tag").alias("tag"), F.col("rule_id").alias("source"))),
        *[F.when(c.isNotNull(), F.struct(c.cast("string").alias("tag"), F.lit(name).alias("source"))) for name, c in ({"direct": direct} | fallbacks).items()],
    )
    ruled = last_rule(rules.withColumn("rule_tag", F.col("tag")), hit, ["rule_tag"]).withColumnRenamed("id", id_col)
    return features.join(ruled, id_col, "left").select(F.col(id_col).alias("id"), ladder.alias("m")).select("id", "m.tag", "m.source")


def apply_pack(features: DataFrame, id_col: str, rules: DataFrame, hit: DataFrame, controllers: bool = True, cores: bool = True, owner: str = "owner", controller: str = "controller") -> DataFrame:
    """(id, owner, controller, cores, rule_id), hit being targets or last_targets: rules are matched against the baseline, so none sees what another has set; the last
    one sets the owner and, if so asked, the controller and the only core. rule_id is null where nothing was set."""
    ruled = last_rule(rules, hit, ["tag"]).withColumnRenamed("id", id_col)
    own, ctl = F.coalesce("tag", owner), F.coalesce("tag", controller) if controllers else F.col(controller)
    core = F.coalesce(F.col("tag") if cores else F.lit(None).cast("string"), F.col(owner))
    return features.join(ruled, id_col, "left").select(F.col(id_col).alias("id"), own.alias("owner"), ctl.alias("controller"), core.alias("core"), "rule_id")


def pack_errors(rules: DataFrame, hit: DataFrame, applied: DataFrame, retired: DataFrame) -> DataFrame:
    """(error, subject, n): rules that match no feature, and retired tags that still own some."""
    none = empty(rules, hit).select(F.lit("no target").alias("error"), F.col("rule_id").alias("subject"), F.lit(0).cast("long").alias("n"))
    left = applied.join(retired.select(F.col("tag").alias("owner")).distinct(), "owner").groupBy("owner").agg(F.count(F.lit(1)).alias("n"))
    return none.unionByName(left.select(F.lit("retired owner").alias("error"), F.col("owner").alias("subject"), "n"))


def resolve(entries: DataFrame, key: str, sources: list[tuple[str, DataFrame]], default: str) -> DataFrame:
    """(key, status, value): of each entry the first source that has it; sources are (status, table of key and value). One
    aggregate over all sources and one join; of several values of a source the least counts."""
    rows = [t.select(F.col(key), F.lit(rank).alias("rank"), F.lit(status).alias("status"), F.col("value").cast("string").alias("value")) for rank, (status, t) in enumerate(sources)]
    best = reduce(DataFrame.unionByName, rows).groupBy(key).agg(F.min(F.struct("rank", "status", "value")).alias("m"))
    return entries.select(key).join(best, key, "left").select(key, F.coalesce("m.status", F.lit(default)).alias("status"), "m.value")
