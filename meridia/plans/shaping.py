"""Queries of projections and filters (2.B), rankings (2.E), sorts and limits (2.F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions import scalars as S
from meridia.operators import ranking, selection
from meridia.operators import spatial as G

from .joins import polygons
from .registry import query
from .scalars import _KEY, _MERC


def length():
    return S.mercator_length_m(*map(F.col, ("x0", "y0", "x1", "y1")))


@query("b1_country_filter", "SELECT c_custkey, code FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL WHEN regexp_matches(upper(substr(c_mktsegment, 1, 2)), '^[A-Z]{2}$') THEN upper(substr(c_mktsegment, 1, 2)) END AS code FROM customer) WHERE code IN ('BU', 'MA', 'HO') AND code <> 'HO'")
def _(v):
    first = F.when(F.col("c_custkey") % 3 == 0, "-99").otherwise(F.substring("c_mktsegment", 1, 2))
    return v.customer.select("c_custkey", S.first_valid_code(F.lit("-99"), first).alias("code")).where("code IN ('BU', 'MA', 'HO') AND code <> 'HO'")


@query("b2_column_choice", "SELECT o_orderkey, coalesce(nullif(trim(CASE WHEN o_orderkey % 4 = 0 THEN ' ' ELSE o_orderpriority END), ''), nullif(trim(o_orderstatus), '')) AS label FROM orders")
def _(v):
    o = v.orders
    (name,) = [c for c in ("label", "title", "o_orderpriority") if c in o.columns][:1]
    return o.select("o_orderkey", F.coalesce(S.clean(F.when(F.col("o_orderkey") % 4 == 0, " ").otherwise(F.col(name))), S.clean(F.col("o_orderstatus"))).alias("label"))


@query("b3_bbox_intersects", "SELECT segment_id FROM segments WHERE least(x0, x1) <= 40 AND greatest(x0, x1) >= -10 AND least(y0, y1) <= 60 AND greatest(y0, y1) >= 30")
def _(v):
    return v.segments.where((F.least("x0", "x1") <= 40) & (F.greatest("x0", "x1") >= -10) & (F.least("y0", "y1") <= 60) & (F.greatest("y0", "y1") >= 30)).select("segment_id")


@query("b4_clip_to_bounds", "SELECT zone_id, greatest(xmin, -100.0) AS xmin, greatest(ymin, -30.0) AS ymin, least(xmax, 100.0) AS xmax, least(ymax, 30.0) AS ymax FROM zones WHERE xmin <= 100 AND xmax >= -100 AND ymin <= 30 AND ymax >= -30")
def _(v):
    z = v.zones.where("xmin <= 100 AND xmax >= -100 AND ymin <= 30 AND ymax >= -30")
    return z.select("zone_id", F.greatest("xmin", F.lit(-100.0)).alias("xmin"), F.greatest("ymin", F.lit(-30.0)).alias("ymin"), F.least("xmax", F.lit(100.0)).alias("xmax"), F.least("ymax", F.lit(30.0)).alias("ymax"))


@query("b5_column_pruning", "SELECT feature_id, nullif(trim(owner), 'Brand#1') AS owner FROM features")
def _(v):
    return v.features.select("feature_id", F.nullif(F.trim("owner"), F.lit("Brand#1")).alias("owner"))


@query("b6_small_part_cull", "SELECT place_id FROM (SELECT *, max(population) OVER (PARTITION BY home_unit_id) AS top FROM places) WHERE population >= 500000 OR population = top OR place_id % 100 = 0")
def _(v):
    top = v.places.groupBy("home_unit_id").agg(F.max("population").alias("top"))
    return v.places.join(top, "home_unit_id").where("population >= 500000 OR population = top OR place_id % 100 = 0").select("place_id")


@query("b7_despeckle", "SELECT p_brand AS owner, min(p_name) AS name, count(*) AS parts, CAST(sum(p_size) AS BIGINT) AS size FROM part WHERE p_size >= 4 OR (SELECT max(p_size) FROM part) < 4 GROUP BY p_brand")
def _(v):
    return selection.despeckle(v.part, "p_brand", F.col("p_size"), 4, {"name": F.min("p_name"), "parts": F.count(F.lit(1)), "size": F.sum("p_size")}).withColumnRenamed("p_brand", "owner")


@query("b8_length_threshold", f"SELECT segment_id FROM segments WHERE {_MERC} >= CASE class WHEN 'motorway' THEN 5000 WHEN 'trunk' THEN 15000 ELSE 30000 END")
def _(v):
    policy = v.spark.createDataFrame([("motorway", 5000.0), ("trunk", 15000.0), ("unknown", 30000.0)], "class string, least double")
    return v.segments.join(F.broadcast(policy), "class").where(length() >= F.col("least")).select("segment_id")


@query("b9_preview_tiers", f"SELECT segment_id, CASE WHEN class = 'motorway' AND {_MERC} >= 30000 THEN 'core' WHEN class IN ('motorway', 'trunk') THEN 'expanded' ELSE 'full' END AS tier FROM segments")
def _(v):
    tier = F.when((F.col("class") == "motorway") & (length() >= 30000), "core").when(F.col("class").isin("motorway", "trunk"), "expanded").otherwise("full")
    return v.segments.select("segment_id", tier.alias("tier"))


@query("b10_keep_mask", "SELECT place_id FROM places WHERE place_id % 3 <> 0 OR population >= 350000 OR kind = 'BUILDING' OR place_id % 97 = 0")
def _(v):
    reasons = [F.col("place_id") % 3 != 0, F.col("population") >= 350000, F.col("kind") == "BUILDING", F.col("place_id") % 97 == 0]
    return v.places.where(F.exists(F.array(*reasons), lambda x: x)).select("place_id")


@query("b11_explicit_predicate", "SELECT feature_id, NOT (name LIKE 'blue%' OR name LIKE '%bolt%' OR owner IN ('Brand#1', 'Brand#2')) AS explicit FROM features")
def _(v):
    out = F.col("name").startswith("blue") | F.col("name").contains("bolt") | F.col("owner").isin("Brand#1", "Brand#2")
    return v.features.select("feature_id", (~out).alias("explicit"))


@query("b12_prefix_strip", "SELECT segment_id FROM segments WHERE segment_id NOT LIKE '1%'")
def _(v):
    return v.segments.where(~F.col("segment_id").startswith("1")).select("segment_id")


@query("b13_authoritative_ids", "SELECT group_id, count(DISTINCT child) FILTER (WHERE ok) AS kept, count(DISTINCT child) FILTER (WHERE NOT ok) AS dropped FROM (SELECT l_suppkey AS group_id, l_partkey AS child, l_partkey IN (SELECT feature_id FROM features WHERE feature_id % 3 <> 0) AS ok FROM lineitem) GROUP BY group_id")
def _(v):
    pairs = v.lineitem.select(F.col("l_suppkey").alias("group_id"), F.col("l_partkey").alias("child")).distinct()
    ok = v.features.where("feature_id % 3 <> 0").select(F.col("feature_id").alias("child"), F.lit(True).alias("ok"))
    return pairs.join(ok, "child", "left").groupBy("group_id").agg(F.count("ok").alias("kept"), F.count_if(F.col("ok").isNull()).alias("dropped"))


@query("b14_required_keys", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT feature_id FROM features WHERE unit_id < 5 UNION SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(v):
    need = v.features.where("unit_id < 5").select(F.col("feature_id").alias("c_custkey")).union(v.orders.where("o_orderstatus = 'P'").select("o_custkey"))
    return v.customer.select("c_custkey").join(need, "c_custkey", "left_semi")


@query("b15_usage_whitelist", "WITH hit AS (SELECT DISTINCT user_id FROM events WHERE event_type <> 'error'), miss AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error') SELECT (SELECT count(*) FROM hit) AS hits, (SELECT count(*) FROM miss WHERE user_id NOT IN (SELECT user_id FROM hit)) AS unresolved, (SELECT count(*) FROM (SELECT user_id FROM hit INTERSECT SELECT c_custkey FROM customer)) AS whitelisted")
def _(v):
    seen = v.events.groupBy(F.col("user_id").alias("k")).agg(F.max(F.col("event_type") != "error").alias("hit"))
    known = v.customer.select(F.col("c_custkey").alias("k"), F.lit(1).alias("known"))
    return seen.join(known, "k", "left").agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("unresolved"), F.count_if(F.col("hit") & F.col("known").isNotNull()).alias("whitelisted"))


@query("b16_named_union", "SELECT spec, count(*) AS members, min(xmin) AS xmin, max(xmax) AS xmax FROM (SELECT z.xmin, z.xmax, CASE WHEN z.zone_id % 10 < 3 THEN 'a' WHEN z.zone_id % 10 < 5 THEN 'b' END AS spec FROM zones z) WHERE spec IS NOT NULL GROUP BY spec")
def _(v):
    specs = v.spark.createDataFrame([("a", 0), ("a", 1), ("a", 2), ("b", 3), ("b", 4)], "spec string, tail int")
    return v.zones.join(F.broadcast(specs), F.col("zone_id") % 10 == F.col("tail")).groupBy("spec").agg(F.count("*").alias("members"), F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))


@query("b17_mask_clip", "SELECT p.home_unit_id, count(*) FILTER (WHERE u.unit_id IS NULL) AS excluded, count(u.unit_id) AS kept FROM places p LEFT JOIN units u ON u.unit_id % 3 = 0 AND p.lon >= u.xmin AND p.lon < u.xmax AND p.lat >= u.ymin AND p.lat < u.ymax GROUP BY p.home_unit_id")
def _(v):
    inside = G.within(v.places.select("place_id", "lon", "lat"), polygons(v.units.where("unit_id % 3 = 0"), "unit_id"), "rings", key="unit_id").select("place_id", F.lit(1).alias("hit"))
    return v.places.join(inside, "place_id", "left").groupBy("home_unit_id").agg(F.count_if(F.col("hit").isNull()).alias("excluded"), F.count("hit").alias("kept"))


@query("b18_elevation_prep", "SELECT r // 2 AS r, c // 2 AS c, round(avg(CASE WHEN value > 10 THEN value END), 9) AS value FROM pixels GROUP BY r // 2, c // 2")
def _(v):
    return v.pixels.groupBy(F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("c") / 2).alias("c")).agg(F.round(F.avg(F.when(F.col("value") > 10, F.col("value"))), 9).alias("value"))


@query("b19_exclusions", "SELECT place_id FROM places WHERE (home_unit_id, lower(name)) NOT IN (SELECT home_unit_id, lower(name) FROM gazetteer_b WHERE place_id % 2 = 0)")
def _(v):
    out = v.gazetteer_b.where("place_id % 2 = 0").select("home_unit_id", F.lower("name").alias("key"))
    return v.places.withColumn("key", F.lower("name")).join(out, ["home_unit_id", "key"], "left_anti").select("place_id")


@query("e1_best_per_key", "SELECT home_unit_id, place_id FROM (SELECT *, row_number() OVER (PARTITION BY home_unit_id ORDER BY place_id % 97 = 0 DESC, population DESC, place_id) AS rn FROM places) WHERE rn = 1")
def _(v):
    best = F.max(F.struct((F.col("place_id") % 97 == 0).alias("cap"), "population", (-F.col("place_id")).alias("p")))
    return v.places.groupBy("home_unit_id").agg(best.alias("b")).select("home_unit_id", (-F.col("b.p")).alias("place_id"))


@query("e2_dedupe_then_rank", f"SELECT place_id, row_number() OVER (PARTITION BY home_unit_id ORDER BY population DESC, place_id) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY home_unit_id, {_KEY % 'kind'} || place_id % 5 ORDER BY population DESC, place_id) AS rn FROM places) WHERE rn = 1")
def _(v):
    key = F.concat(S.latin_key(F.col("kind")), (F.col("place_id") % 5).cast("string"))
    one = v.places.groupBy("home_unit_id", key.alias("key")).agg(F.max(F.struct("population", (-F.col("place_id")).alias("p"))).alias("b"))
    placed = selection.numbered_within(one.select("home_unit_id", "b.population", "b.p"), ["home_unit_id"], [-F.col("population"), -F.col("p")], "n")
    return placed.select((-F.col("p")).alias("place_id"), (F.col("n") + 1).alias("rank"))


@query("e3_ordinal_suffix", "SELECT feature_id, owner || CASE WHEN rn > 1 THEN '__' || (rn - 1) ELSE '' END AS uid FROM (SELECT *, row_number() OVER (PARTITION BY owner, unit_id ORDER BY feature_id) AS rn FROM features)")
def _(v):
    return ranking.ordinal_suffix(v.features, ["owner", "unit_id"], [F.col("feature_id")], F.col("owner"), "uid").select("feature_id", "uid")


@query("e4_first_match", "SELECT feature_id, min(seq) AS seq, arg_min(value, seq) AS value FROM mutations WHERE value IS NOT NULL GROUP BY feature_id")
def _(v):
    return v.mutations.where("value IS NOT NULL").groupBy("feature_id").agg(F.min("seq").alias("seq"), F.min_by("value", "seq").alias("value"))


@query("e5_group_max_flag", "SELECT place_id, population = max(population) OVER (PARTITION BY home_unit_id) AS is_max FROM places")
def _(v):
    top = v.places.groupBy("home_unit_id").agg(F.max("population").alias("top"))
    return v.places.join(top, "home_unit_id").select("place_id", (F.col("population") == F.col("top")).alias("is_max"))


@query("e6_sequential_ids", "SELECT feature_id, 'f::' || row_number() OVER (ORDER BY owner, feature_id) AS seq_id FROM features")
def _(v):
    return ranking.sequential_ids(v.features.select("owner", "feature_id"), [F.col("owner"), F.col("feature_id")], "seq_id", "f::").select("feature_id", "seq_id")


@query("e7_quota_reveal", "SELECT place_id FROM (SELECT *, row_number() OVER (PARTITION BY home_unit_id ORDER BY population DESC, place_id) AS rn FROM places) WHERE rn <= CASE WHEN home_unit_id % 2 = 0 THEN 5 ELSE 2 END ORDER BY rn, population DESC, place_id LIMIT 60")
def _(v):
    quota = F.when(F.col("home_unit_id") % 2 == 0, 5).otherwise(2)
    return ranking.quota_reveal(v.places, "home_unit_id", [F.desc("population"), F.col("place_id")], quota, 60).select("place_id")


@query("e9_candidate_confidence", "SELECT home_unit_id, place_id, CASE WHEN n >= 2 AND population >= 350000 THEN 'high' WHEN population >= 350000 THEN 'medium' ELSE 'low' END AS confidence FROM (SELECT *, count(*) OVER (PARTITION BY home_unit_id) AS n, row_number() OVER (PARTITION BY home_unit_id ORDER BY population DESC, place_id) AS rn FROM places) WHERE rn = 1")
def _(v):
    best = v.places.groupBy("home_unit_id").agg(F.count("*").alias("n"), F.max(F.struct("population", (-F.col("place_id")).alias("p"))).alias("b"))
    level = F.when((F.col("n") >= 2) & (F.col("b.population") >= 350000), "high").when(F.col("b.population") >= 350000, "medium").otherwise("low")
    return best.select("home_unit_id", (-F.col("b.p")).alias("place_id"), level.alias("confidence"))


@query("e10_quantile_threshold", "SELECT p.place_id FROM places p JOIN (SELECT home_unit_id, quantile_cont(population, 0.8) AS q FROM places GROUP BY home_unit_id) t USING (home_unit_id) WHERE p.population >= t.q OR p.place_id % 50 = 0")
def _(v):
    q = selection.group_quantile(v.places, "home_unit_id", "population", 0.8)
    return v.places.join(q, "home_unit_id").where("population >= q OR place_id % 50 = 0").select("place_id")


@query(
    "e11_largest_remainder",
    """WITH w AS (SELECT home_unit_id AS k, sum(population) AS w FROM places GROUP BY 1), t AS (SELECT sum(w) AS t FROM w),
s AS (SELECT k, (w * 500) // t AS base, (w * 500) % t AS rest FROM w, t), r AS (SELECT k, base, row_number() OVER (ORDER BY rest DESC, k) AS rn FROM s)
SELECT k, CAST(base + CASE WHEN rn <= 500 - (SELECT sum(base) FROM s) THEN 1 ELSE 0 END AS BIGINT) AS seats FROM r""",
)
def _(v):
    w = v.places.groupBy(F.col("home_unit_id").alias("k")).agg(F.sum("population").alias("w"))
    return ranking.largest_remainder(w, "k", "w", 500)


@query("e13_continue_suffix", "WITH n AS (SELECT owner, max(feature_id) AS top FROM features WHERE feature_id % 2 = 0 GROUP BY owner) SELECT f.feature_id, f.owner || '_' || lpad(CAST(coalesce(n.top, 0) + row_number() OVER (PARTITION BY f.owner ORDER BY f.feature_id) AS VARCHAR), 6, '0') AS new_id FROM features f LEFT JOIN n USING (owner) WHERE f.feature_id % 2 = 1")
def _(v):
    new, old = v.features.where("feature_id % 2 = 1"), v.features.where("feature_id % 2 = 0")
    return ranking.continue_suffix(new, old, "owner", F.col("feature_id"), [F.col("feature_id")], "new_id").select("feature_id", "new_id")


@query("e14_name_by_best_place", "SELECT u.unit_id, coalesce(arg_max(p.name, p.population * 10000000 - p.place_id), any_value(u.name)) AS name FROM units u LEFT JOIN places p ON p.home_unit_id = u.unit_id AND p.population >= 2000000 GROUP BY u.unit_id")
def _(v):
    best = v.places.where("population >= 2000000").groupBy(F.col("home_unit_id").alias("unit_id")).agg(F.max_by("name", F.struct("population", -F.col("place_id"))).alias("best"))
    return v.units.join(best, "unit_id", "left").select("unit_id", F.coalesce("best", "name").alias("name"))


@query("f1_multi_key_sort", "SELECT row_number() OVER (ORDER BY home_unit_id, population DESC, place_id) AS pos, place_id FROM places")
def _(v):
    sorted_ = selection.numbered(v.places.select("home_unit_id", "population", "place_id"), [F.col("home_unit_id"), -F.col("population"), F.col("place_id")], "number")
    return sorted_.select((F.col("number") + 1).alias("pos"), "place_id")


@query("f2_top_n", "SELECT place_id, population FROM places ORDER BY population DESC, place_id LIMIT 25")
def _(v):
    return v.places.orderBy(F.desc("population"), "place_id").limit(25).select("place_id", "population")


@query("f4_chunk_priority_sort", "SELECT zone_id FROM zones ORDER BY zone_id % 3, round((xmax + xmin) / 2, 4) DESC, zone_id LIMIT 40")
def _(v):
    return v.zones.orderBy(F.col("zone_id") % 3, F.round((F.col("xmax") + F.col("xmin")) / 2, 4).desc(), "zone_id").limit(40).select("zone_id")
