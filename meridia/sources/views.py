"""Map layers derived from the plain tables by SQL that Spark and ANSI engines read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "places": "SELECT c_custkey AS place_id, c_name AS name, CAST(c_nationkey AS BIGINT) AS home_unit_id, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((c_custkey * 104729) % 14000 AS DOUBLE) / 100 - 70 AS lat, CAST(FLOOR(ABS(c_acctbal) * 1000) AS BIGINT) AS population, c_mktsegment AS kind FROM customer",
    "depots": "SELECT s_suppkey AS depot_id, s_name AS name, CAST(s_nationkey AS BIGINT) AS home_unit_id, CAST((s_suppkey * 15485863) % 36000 AS DOUBLE) / 100 - 180 AS lon, CAST((s_suppkey * 32452843) % 14000 AS DOUBLE) / 100 - 70 AS lat FROM supplier",
    "units": "SELECT CAST(n_nationkey AS BIGINT) AS unit_id, n_name AS name, CAST(n_regionkey AS BIGINT) AS group_id, CAST(-180 + 72 * (n_nationkey % 5) AS DOUBLE) AS xmin, CAST(-70 + 28 * FLOOR(n_nationkey / 5.0) AS DOUBLE) AS ymin, CAST(-108 + 72 * (n_nationkey % 5) AS DOUBLE) AS xmax, CAST(-42 + 28 * FLOOR(n_nationkey / 5.0) AS DOUBLE) AS ymax FROM nation",
    "zones": "SELECT CAST(s_suppkey AS BIGINT) AS zone_id, CAST((s_suppkey * 15485863) % 33000 AS DOUBLE) / 100 - 180 AS xmin, CAST((s_suppkey * 32452843) % 11000 AS DOUBLE) / 100 - 70 AS ymin, CAST((s_suppkey * 15485863) % 33000 AS DOUBLE) / 100 - 150 AS xmax, CAST((s_suppkey * 32452843) % 11000 AS DOUBLE) / 100 - 50 AS ymax FROM supplier",
    "gazetteer_b": "SELECT c_custkey + 1000000 AS place_id, UPPER(c_name) AS name, CAST(c_nationkey AS BIGINT) AS home_unit_id, CAST((c_custkey * 7919) % 36000 AS DOUBLE) / 100 - 180 + CAST(c_custkey % 7 AS DOUBLE) / 10 AS lon, CAST((c_custkey * 104729) % 14000 AS DOUBLE) / 100 - 70 AS lat FROM customer WHERE c_custkey % 3 = 0",
    "segments": "SELECT CONCAT(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS segment_id, CASE l_returnflag WHEN 'A' THEN 'motorway' WHEN 'N' THEN 'trunk' ELSE 'unknown' END AS class, CAST((l_partkey * 7919) % 36000 AS DOUBLE) / 100 - 180 AS x0, CAST((l_suppkey * 104729) % 14000 AS DOUBLE) / 100 - 70 AS y0, CAST((l_partkey * 7919) % 36000 AS DOUBLE) / 100 - 180 + l_quantity / 100 AS x1, CAST((l_suppkey * 104729) % 14000 AS DOUBLE) / 100 - 70 + l_discount AS y1 FROM lineitem",
    "features": "SELECT p_partkey AS feature_id, p_partkey % 25 AS unit_id, p_brand AS owner, CASE WHEN p_size % 7 = 0 THEN 'Brand#0' ELSE p_brand END AS controller, p_name AS name FROM part",
    "mutations": "SELECT event_id AS seq, ts, user_id AS feature_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS value FROM events",
    "pixels": "SELECT l_orderkey % 64 AS r, l_partkey % 128 AS c, MAX(l_quantity) AS value FROM lineitem GROUP BY l_orderkey % 64, l_partkey % 128",
}


class Layers:
    """layers.places and the like: a derived layer, or else the table of that name, as a DataFrame."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        (source,) = re.findall(r"FROM (\w+)", VIEWS[name])
        return self.spark.sql(re.sub(r"FROM \w+", "FROM {src}", VIEWS[name]), src=getattr(self, source))


def with_views(sql: str) -> str:
    """sql with a WITH clause for the views that it names."""
    used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v]})" for v in used)
    body = sql.strip()
    for start in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(start):
            return f"{start}{head}, {body[len(start):]}"
    return f"WITH {head} {body}"
