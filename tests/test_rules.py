"""Rules whose targets are not expanded, against those that are."""

import random

from pyspark.sql import functions as F

from meridia.operators import rules


def tables(spark):
    rng = random.Random(5)
    given = [(f"r{i}", rng.choice([0, 1, 2, None]), [rng.choice("abcd")] if i % 3 else [], [str(rng.randrange(60))], [rng.choice("abx")] if i % 7 == 0 else [], [str(rng.randrange(60)) for _ in range(9)]) for i in range(40)]
    table = spark.createDataFrame(given, "rule_id string, priority int, groups array<string>, ids array<string>, not_groups array<string>, not_ids array<string>")
    chosen = rules.selectors(table, {"group": ("groups", "not_groups"), "id": ("ids", "not_ids")})
    features = spark.range(50).withColumn("g", F.substring(F.lit("abcde"), (F.col("id") % 5 + 1).cast("int"), F.lit(1)))
    return table, chosen, rules.members(features, "id", {"group": F.col("g"), "id": F.col("id")})


def test_last_targets_are_the_last_of_all_targets(spark):
    table, chosen, known = tables(spark)
    hit = rules.targets(chosen, known)
    want = rules.last_rule(table, hit, []).collect()
    got = rules.last_rule(table, rules.last_targets(table, chosen, known), []).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 30
    assert {r.rule_id for r in rules.with_target(chosen, known).collect()} == {r.rule_id for r in hit.collect()}


def test_rows_do_not_grow_with_rules_times_features(spark):
    # 300 rules for the one country of 300 features: a row for each feature, not for each pair.
    table = spark.range(300).select(F.concat(F.lit("r"), "id").alias("rule_id"), F.lit(1).alias("priority"), F.array(F.lit("a")).alias("c"), F.array(F.col("id").cast("string")).alias("x"), F.array().cast("array<string>").alias("none"))
    chosen = rules.selectors(table, {"country": ("c", "none"), "id": ("none", "x")})
    known = rules.members(spark.range(300).withColumn("c", F.lit("a")), "id", {"country": F.col("c"), "id": F.col("id")})
    last = rules.last_targets(table, chosen, known)
    assert last.count() == 300
    rows = [m for m in _outputs(last)]
    assert rows and max(rows) <= 1300


def _outputs(df):
    """Output rows of the plan's joins."""
    df.collect()
    text, stack = [], [df._jdf.queryExecution().executedPlan()]
    while stack:
        p = stack.pop()
        name = p.getClass().getSimpleName()
        stack += [p.executedPlan()] if name == "AdaptiveSparkPlanExec" else [p.plan()] if name.endswith("QueryStageExec") else []
        it = p.children().iterator()
        while it.hasNext():
            stack.append(it.next())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            text.append(p.metrics().apply("numOutputRows").value())
    return text
