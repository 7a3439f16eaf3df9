"""Queries of the streams (2.L); each runs a stream over the whole log and is held against the batch result."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.streaming import edits as T

from .registry import query


def log(v):
    events = T.read_stream(v.spark, f"{v.sf_dir}/events.parquet")
    return events.selectExpr("event_id AS seq", "ts", "user_id AS feature_id", "CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value")


def days(v):
    return T.windowed_counts(log(v).where("value IS NOT NULL"), "ts", "value", "1 day", "2 days").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("l1_latest_state", "SELECT feature_id, seq, value, edits FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY seq DESC) AS rn, count(*) OVER (PARTITION BY feature_id) AS edits FROM mutations) WHERE rn = 1")
def _(v):
    return T.latest_state(log(v), "feature_id", "seq", "value")


@query("l2_running_counts", "SELECT value, count(*) AS features FROM (SELECT *, row_number() OVER (PARTITION BY feature_id ORDER BY seq DESC) AS rn FROM mutations) WHERE rn = 1 AND value IS NOT NULL GROUP BY value")
def _(v):
    return T.latest_state(log(v), "feature_id", "seq", "value").where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("features"))


def last_two(edits):
    # The last two edits up to the point, picked in each task before the shuffle: the state, and what an undo goes back to.
    rn = F.row_number().over(Window.partitionBy("feature_id").orderBy(F.desc("seq")))
    two = edits.withColumn("rn", rn).where("rn <= 2")
    return two.groupBy("feature_id").agg(F.max(F.when(F.col("rn") == 1, F.col("value"))).alias("value"), F.max(F.when(F.col("rn") == 2, F.col("value"))).alias("before"))


@query("l3_state_at", "SELECT feature_id, value, before FROM (SELECT *, lag(value) OVER (PARTITION BY feature_id ORDER BY seq) AS before, row_number() OVER (PARTITION BY feature_id ORDER BY seq DESC) AS rn FROM mutations) WHERE rn = 1")
def _(v):
    return last_two(v.mutations)  # the point is the log's end


@query("l3_state_at_point", "SELECT feature_id, value, before FROM (SELECT *, lag(value) OVER (PARTITION BY feature_id ORDER BY seq) AS before, row_number() OVER (PARTITION BY feature_id ORDER BY seq DESC) AS rn FROM mutations WHERE seq <= (SELECT min(seq) + (max(seq) - min(seq)) // 10 * 7 FROM mutations)) WHERE rn = 1")
def _(v):
    # The point lies seven tenths into the log's range of numbers; every edit up to it counts.
    point = v.mutations.agg(F.expr("min(seq) + (max(seq) - min(seq)) div 10 * 7").alias("point"))
    return last_two(v.mutations.crossJoin(F.broadcast(point)).where("seq <= point"))


@query("l4_micro_batch_ingest", "SELECT CAST(floor((x0 + 180) / 60) AS BIGINT) AS shard, count(*) AS n, round(sum(x1 - x0), 4) AS width FROM segments GROUP BY 1")
def _(v):
    rows = T.read_stream(v.spark, f"{v.sf_dir}/lineitem.parquet")
    x0 = ((F.col("l_partkey") * 7919) % 36000).cast("double") / 100 - 180
    table = T.ingest(rows.select(F.floor((x0 + 180) / 60).alias("shard"), x0.alias("x0"), (x0 + F.col("l_quantity") / 100).alias("x1")), "shard")
    return table.groupBy(F.col("shard").cast("long").alias("shard")).agg(F.count("*").alias("n"), F.round(F.sum(F.col("x1") - F.col("x0")), 4).alias("width"))


@query("l5_windowed_counts", "WITH w AS (SELECT time_bucket(INTERVAL '1 day', ts) AS start, value, count(*) AS n FROM mutations WHERE value IS NOT NULL GROUP BY 1, 2), t AS (SELECT max(ts) - INTERVAL '2 days' AS mark FROM mutations WHERE value IS NOT NULL) SELECT start, value, n FROM w, t WHERE start + INTERVAL '1 day' <= mark")
def _(v):
    return days(v).where("closed").drop("closed")


@query("l5_windowed_counts_all", "SELECT time_bucket(INTERVAL '1 day', ts) AS start, value, count(*) AS n FROM mutations WHERE value IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2")
def _(v):
    return days(v).drop("closed")
