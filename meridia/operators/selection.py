"""Selection under a budget and exact ranks, with bounded rows in any one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridia.sources.shared import scratch


def within_budget(rows: DataFrame, group: str, order: list[Column], id_col: str, cost: Column, budget: int, most: int, least: int = 0) -> DataFrame:
    """(group, pos, id, used): each group's rows in order while their whole costs fit the budget; one that does not fit is passed
    over and later ones may still fit. The first least rows are taken whatever they cost, and never more than most.

    Of rows of one cost, once one does not fit no later one does. So of each (group, cost) only the first
    least + budget / cost + 1 can be taken, and no more than most: these few are gathered, not the group.
    """
    by_cost = F.row_number().over(Window.partitionBy(group, "cost").orderBy(*[f"o{i}" for i in range(len(order))], "id"))
    keyed = rows.select(group, F.col(id_col).alias("id"), F.greatest(cost.cast("long"), F.lit(0).cast("long")).alias("cost"), *[c.alias(f"o{i}") for i, c in enumerate(order)])
    few = keyed.withColumn("nth", by_cost).where(F.col("nth") <= most)
    few = few.where((F.col("cost") == 0) | (F.col("nth") <= least + 1 + F.expr(f"{budget} div greatest(cost, 1)")))
    lists = few.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(*[f"o{i}" for i in range(len(order))], "id", "cost"))).alias("rows"))
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(f"array<{rows.schema[id_col].dataType.simpleString()}>").alias("ids"))

    def step(a: Column, r: Column) -> Column:
        takes = (F.size(a["ids"]) < most) & ((F.size(a["ids"]) < least) | (a["used"] + r["cost"] <= budget))
        return F.struct((a["used"] + F.when(takes, r["cost"]).otherwise(0)).alias("used"), F.when(takes, F.concat(a["ids"], F.array(r["id"]))).otherwise(a["ids"]).alias("ids"))

    chosen = lists.select(group, F.aggregate("rows", zero, step).alias("s")).select(group, "s.used", F.posexplode("s.ids").alias("pos", "id"))
    return chosen.select(group, "pos", "id", "used")


def numbered(rows: DataFrame, order: list[Column], number: str = "number") -> DataFrame:
    """rows with their places from 0 in the whole order: a range shuffle, a place in each partition, and the counts of the partitions
    before (a row each). Ties are numbered in any order."""
    names = [f"_order_{i}" for i in range(len(order))]
    dealt = rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)]).repartitionByRange(*names)
    placed = scratch(dealt.withColumn("_part", F.spark_partition_id()), "numbered")  # bounds of ranges may differ if they are drawn again
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*names)) - 1
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return placed.withColumn("_rank", rank).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_rank") + F.col("_before")).alias(number))


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt over all cores by keys: for work that is long for the bytes of its rows, which Spark would leave to few tasks."""
    return rows.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, *keys)


def running(rows: DataFrame, order: list[Column], value: str, name: str) -> DataFrame:
    """rows with the sum of a column of whole numbers, without nulls, up to and with each row in the whole order, as numbered has their places."""
    names = [f"_order_{i}" for i in range(len(order))]
    dealt = rows.select("*", *[c.alias(n) for c, n in zip(order, names, strict=True)]).repartitionByRange(*names)
    placed = scratch(dealt.withColumn("_part", F.spark_partition_id()), "running")
    upto = F.sum(value).over(Window.partitionBy("_part").orderBy(*names).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sizes = placed.groupBy("_part").agg(F.sum(value).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return placed.withColumn("_upto", upto).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_upto") + F.col("_before")).alias(name))


def numbered_within(rows: DataFrame, keys: list[str], order: list[Column], number: str = "number") -> DataFrame:
    """rows with their places from 0 among those of their keys: places in the whole order less that of the key's first row, so that the rows of one
    key may lie in many tasks. Ties are numbered in any order."""
    every = numbered(rows, [*[F.col(k) for k in keys], *order], "_all")
    first = every.groupBy(*keys).agg(F.min("_all").alias("_first")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], "_first")
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    return every.join(first, on).select(*rows.columns, (F.col("_all") - F.col("_first")).alias(number))


def group_quantile(rows: DataFrame, key: str, value: str, share: float, name: str = "q") -> DataFrame:
    """(key, name): the exact quantile of each key's values that are not null, between two of them in proportion. No task holds more of a key than a range."""
    known = rows.where(F.col(value).isNotNull()).select(key, value)
    placed = scratch(numbered_within(known, [key], [F.col(value)], "_at"), "quantile")
    sizes = placed.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).select(F.col(key).alias("_key"), ((F.col("_n") - 1) * share).alias("_place"))
    near = placed.join(sizes, F.col(key).eqNullSafe(F.col("_key"))).where("_at = floor(_place) OR _at = ceil(_place)")
    low, high = F.max(F.when(F.col("_at") == F.floor("_place"), F.col(value))), F.max(F.when(F.col("_at") == F.ceil("_place"), F.col(value)))
    return near.groupBy(key).agg((low + (high - low) * F.max(F.col("_place") - F.floor("_place"))).alias(name))


def following(rows: DataFrame, keys: list[str], order: list[str], take: list[str], name: str = "next") -> DataFrame:
    """rows with a struct of the columns take of the row that comes next in order among those of its keys, null for the last. By ranges of keys and
    order, so that the rows of one key may lie in many tasks; the first row of each range (a row a partition) goes to all."""
    dealt = rows.repartitionByRange(*keys, *order)
    placed = scratch(dealt.withColumn("_part", F.spark_partition_id()), "following")
    w = Window.partitionBy("_part").orderBy(*keys, *order)
    own, ahead = F.struct(*keys), F.struct(F.struct(*keys).alias("k"), F.struct(*take).alias("v"))
    firsts = placed.groupBy("_part").agg(F.min(F.struct(*keys, *order, *[F.col(t).alias("_t_" + t) for t in take])).alias("f"))
    head = F.struct(F.struct(*[F.col(f"f.{k}").alias(k) for k in keys]).alias("k"), F.struct(*[F.col(f"f._t_{t}").alias(t) for t in take]).alias("v"))
    after = firsts.select("_part", F.lead(head).over(Window.orderBy("_part")).alias("_after"))  # a row for each partition
    seen = placed.withColumn("_ahead", F.lead(ahead).over(w)).join(F.broadcast(after), "_part").withColumn("_ahead", F.coalesce("_ahead", "_after"))
    return seen.select(*rows.columns, F.when(F.col("_ahead.k").eqNullSafe(own), F.col("_ahead.v")).alias(name))


def at_ranks(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row: n, top and, for each name, the value at place round((n - 1) * share) of the values in order. Places come from counts of distinct
    values, numbered by ranges; no task holds more than one range."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("k"))
    dealt = counts.repartitionByRange(F.col(value))
    placed = scratch(dealt.withColumn("_part", F.spark_partition_id()), "ranks")
    sizes = placed.groupBy("_part").agg(F.sum("k").alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    upto = F.sum("k").over(Window.partitionBy("_part").orderBy(value)) + F.col("_before")
    seen = placed.join(F.broadcast(before), "_part").select(value, (upto - F.col("k")).alias("lo"), upto.alias("hi"))
    whole = counts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("n"), F.max(value).alias("top"))
    picks = seen.crossJoin(F.broadcast(whole)).agg(*[F.max(F.when((F.col("lo") <= (r := F.round((F.col("n") - 1) * s).cast("long"))) & (r < F.col("hi")), F.col(value))).alias(name) for name, s in shares.items()])
    return whole.crossJoin(picks)  # one row each


def despeckle(rows: DataFrame, key: str, size: Column, least: float, regroup: dict[str, Column]) -> DataFrame:
    """Rows smaller than least are dropped, unless all would go, and the rest is regrouped by key with these aggregates. A null size is small."""
    top = rows.agg(F.max(size).alias("_top"))  # one row
    kept = rows.crossJoin(F.broadcast(top)).where((size >= least) | (F.coalesce("_top", F.lit(least - 1)) < least))
    return kept.groupBy(key).agg(*[c.alias(name) for name, c in regroup.items()])
