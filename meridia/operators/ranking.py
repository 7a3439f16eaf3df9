"""Numbers, suffixes, quotas and seats. Full numbers within a key go by ranges, so that a hot key is many tasks; windows are where few rows of a
key count (quotas), or on a row for each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .selection import numbered, numbered_within


def nth(keys: list[str], order: list[Column]) -> Column:
    """The place of a row among those of its keys, from 1."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def ordinal_suffix(rows: DataFrame, keys: list[str], order: list[Column], text: Column, uid: str, joint: str = "__") -> DataFrame:
    """rows with uid: the text for the first row of its keys, text, joint and 1, 2, ... for further ones."""
    placed = numbered_within(rows, keys, order, "_nth")
    return placed.withColumn(uid, F.concat(text, F.when(F.col("_nth") > 0, F.concat(F.lit(joint), F.col("_nth"))).otherwise(""))).drop("_nth")


def sequential_ids(rows: DataFrame, order: list[Column], seq: str, prefix: str) -> DataFrame:
    """rows with gapless ids from 1 in the whole order, by ranges."""
    return numbered(rows, order, "_number").withColumn(seq, F.concat(F.lit(prefix), F.col("_number") + 1)).drop("_number")


def continue_suffix(new: DataFrame, existing: DataFrame, key: str, number: Column, order: list[Column], name: str, digits: int = 6) -> DataFrame:
    """new with a name: its key, an underscore and a number after the greatest that an existing row of the key has (0 if none)."""
    top = existing.groupBy(key).agg(F.max(number).alias("_top"))
    ranked = numbered_within(new, [key], order, "_nth").join(top, key, "left")
    return ranked.withColumn(name, F.concat(key, F.lit("_"), F.lpad((F.coalesce("_top", F.lit(0)) + F.col("_nth") + 1).cast("string"), digits, "0"))).drop("_nth", "_top")


def quota_reveal(rows: DataFrame, key: str, order: list[Column], quota: Column, budget: int) -> DataFrame:
    """Up to quota rows of each key, best first, and of these the first budget by place within the key and then in order."""
    return rows.withColumn("_nth", nth([key], order)).where(F.col("_nth") <= quota).orderBy("_nth", *order).limit(budget).drop("_nth")


def largest_remainder(weights: DataFrame, key: str, weight: str, seats: int, least: int = 0) -> DataFrame:
    """(key, seats): least each, the rest in proportion to whole-number weights, rounded down, and single seats by falling remainder (ties by key)
    until all are given. Rows are keys. Without any weight nobody gets more than least."""
    total = weights.agg(F.sum(weight).alias("_t"), F.count(F.lit(1)).alias("_k"))
    share = weights.crossJoin(F.broadcast(total)).withColumn("_m", F.greatest(F.lit(seats) - least * F.col("_k"), F.lit(0)))  # total is one row
    share = share.selectExpr(key, "_m", f"CASE WHEN _t > 0 THEN ({weight} * _m) div _t ELSE 0 END AS _base", f"CASE WHEN _t > 0 THEN ({weight} * _m) % _t END AS _rest")
    left = share.agg((F.max("_m") - F.sum("_base")).alias("_left"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("_rest"), key))
    given = F.col("_base") + ((F.col("_place") <= F.col("_left")) & F.col("_rest").isNotNull()).cast("int") + least
    return share.withColumn("_place", place).crossJoin(F.broadcast(left)).select(key, given.alias("seats"))


def scaled_seats(weights: DataFrame, key: str, weight: str, seats: int, most: int) -> DataFrame:
    """(key, seats): clip(round(scale * weight), 1, most) with the scale bisected to that many seats in all. Where keys step together, single
    seats are added by weight / seats or taken by seats / weight (ties by key) until the sum is met, as far as 1 and most allow. Rows are keys."""
    lists = weights.agg(F.collect_list(weight).alias("ws"), F.sum(weight).alias("t"))
    clip = lambda x: F.least(F.lit(float(most)), F.greatest(F.lit(1.0), F.round(x)))
    total = lambda ws, s: F.aggregate(ws, F.lit(0.0), lambda a, x: a + clip(x * s))
    zero = F.struct(F.lit(0.0).alias("lo"), (F.lit(float(seats) * most / 3) / F.col("t")).alias("hi"))

    def step(a: Column, _i: Column) -> Column:
        mid = (a["lo"] + a["hi"]) / 2
        low = total(F.col("ws"), mid) < seats
        return F.struct(F.when(low, mid).otherwise(a["lo"]).alias("lo"), F.when(low, a["hi"]).otherwise(mid).alias("hi"))

    scale = lists.select("ws", F.aggregate(F.sequence(F.lit(1), F.lit(60)), zero, step)["hi"].alias("scale"))
    scale = scale.select("scale", (total(F.col("ws"), F.col("scale")) - seats).cast("int").alias("over"))
    given = weights.select(key, F.col(weight).alias("w")).crossJoin(F.broadcast(scale)).withColumn("seats", clip(F.col("w") * F.col("scale")).cast("int"))
    add, take = F.expr(f"CASE WHEN over < 0 AND seats < {most} THEN sequence(seats + 1, {most}) END"), F.expr("CASE WHEN over > 0 AND seats > 1 THEN sequence(seats, 2, -1) END")
    steps = given.withColumn("step", F.explode(F.concat(F.array(F.lit(None).cast("int")), F.coalesce(add, take, F.array().cast("array<int>")))))  # a null step for the key itself
    need = F.expr("CASE WHEN over < 0 THEN w / step WHEN w > 0 THEN step / w ELSE double('infinity') END")
    order = Window.orderBy(F.col("step").isNull(), need.desc(), key, F.abs(F.col("step") - F.col("seats")))
    ranked = steps.withColumn("chosen", (F.row_number().over(order) <= F.abs("over")) & F.col("step").isNotNull())
    change = F.sum(F.when(F.col("chosen"), -F.signum("over")).otherwise(0))
    return ranked.groupBy(key).agg((F.max("seats") + change).cast("int").alias("seats"))
