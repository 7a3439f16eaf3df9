"""Queries of the column functions (2.H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import scalars as S
from meridia.operators import spatial as G

from .registry import query

_KEY = f"trim(regexp_replace(replace(replace(replace(replace(translate(lower(%s), '{S.MARKED}‘’', '{S.PLAIN}'''''), 'ß', 'ss'), 'æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), '[^a-z0-9'']+', ' ', 'g'))"
_MERC = "6378137.0 * sqrt(pow(radians(x1) - radians(x0), 2) + pow(ln(tan(pi() / 4 + radians(y1) / 2)) - ln(tan(pi() / 4 + radians(y0) / 2)), 2))"
_HAV = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians({b} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"
_E2 = "0.0066943799901413165"
_Q = f"((1 - {_E2}) * (sin(radians({{0}})) / (1 - {_E2} * sin(radians({{0}})) * sin(radians({{0}}))) - ln((1 - sqrt({_E2}) * sin(radians({{0}}))) / (1 + sqrt({_E2}) * sin(radians({{0}})))) / (2 * sqrt({_E2}))))"


@query("h1_latin_key", f"SELECT doc_id, {_KEY % 'text'} AS key FROM documents")
def _(v):
    return v.documents.select("doc_id", S.latin_key(F.col("text")).alias("key"))


@query("h2_match_key", r"SELECT doc_id, trim(regexp_replace(lower(text), '\s+', ' ', 'g')) AS key FROM documents")
def _(v):
    return v.documents.select("doc_id", S.match_key(F.col("text")).alias("key"))


@query("h3_alias_split", "SELECT p_partkey, list_filter(list_transform(regexp_split_to_array(p_name || '|' || p_brand || ' ;; ' || p_type, '[|,;/]+'), lambda x: trim(x)), lambda x: x <> '') AS aliases FROM part", lists=("aliases",))
def _(v):
    return v.part.select("p_partkey", S.alias_split(F.concat("p_name", F.lit("|"), "p_brand", F.lit(" ;; "), "p_type")).alias("aliases"))


@query("h4_stable_keys", f"SELECT n_nationkey, 'id::' || n_nationkey AS id_key, 'cntr::' || substr(upper(n_name), 1, 2) || '::' || replace(replace({_KEY % 'n_name'}, '''', ''), ' ', '-') AS cntr_key, 'name::' || replace(replace({_KEY % 'n_name'}, '''', ''), ' ', '-') AS name_key FROM nation")
def _(v):
    s = S.slug(F.col("n_name"))
    return v.nation.select("n_nationkey", F.concat(F.lit("id::"), "n_nationkey").alias("id_key"), F.concat(F.lit("cntr::"), F.substring(F.upper("n_name"), 1, 2), F.lit("::"), s).alias("cntr_key"), F.concat(F.lit("name::"), s).alias("name_key"))


@query("h5_code_from_id", "SELECT c_custkey, CASE WHEN regexp_extract(upper(i), '^([A-Z]{2,3})(?:[_\\-#]|$)', 1) = '' THEN 'UNK' ELSE regexp_extract(upper(i), '^([A-Z]{2,3})(?:[_\\-#]|$)', 1) END AS code FROM (SELECT c_custkey, substr(c_mktsegment, 1, CAST(2 + c_custkey % 4 AS INT)) || '-' || c_custkey AS i FROM customer)")
def _(v):
    i = F.concat(F.expr("substr(c_mktsegment, 1, CAST(2 + c_custkey % 4 AS INT))"), F.lit("-"), "c_custkey")
    return v.customer.select("c_custkey", S.code_from_id(i).alias("code"))


@query("h6_primary_name", "SELECT feature_id, coalesce(nullif(trim(CASE WHEN feature_id % 5 = 0 THEN '  ' ELSE name END), ''), owner) AS primary_name, coalesce(nullif(trim(CASE WHEN feature_id % 5 = 0 THEN '  ' ELSE name END), ''), owner) || ' (' || substr(owner, 1, 2) || ')' AS variant FROM features")
def _(v):
    name = F.coalesce(S.clean(F.when(F.col("feature_id") % 5 == 0, "  ").otherwise(F.col("name"))), F.col("owner"))
    return v.features.select("feature_id", name.alias("primary_name"), F.concat(name, F.lit(" ("), F.substring("owner", 1, 2), F.lit(")")).alias("variant"))


@query("h7_text_tests", "SELECT doc_id, text IS NULL OR trim(text) = '' OR text = lang AS missing, regexp_matches(coalesce(text, ''), '[\\x{3400}-\\x{9fff}]') AS has_cjk, regexp_matches(coalesce(text, ''), '[\\x{e000}-\\x{f8ff}\\x{fffd}]|Ã.|Â.') AS corrupted FROM documents")
def _(v):
    t = F.coalesce("text", F.lit(""))
    return v.documents.select("doc_id", (F.col("text").isNull() | (F.trim("text") == "") | (F.col("text") == F.col("lang"))).alias("missing"), t.rlike("[\\x{3400}-\\x{9fff}]").alias("has_cjk"), t.rlike("[\\x{e000}-\\x{f8ff}\\x{fffd}]|Ã.|Â.").alias("corrupted"))


@query("h8_hash_ids", "SELECT place_id, substr(upper(sha1(name || '|' || home_unit_id || '|' || coalesce(kind, ''))), 1, 12) AS hash_id FROM places")
def _(v):
    return v.places.select("place_id", S.stable_hash(F.col("name"), F.col("home_unit_id"), F.col("kind")).alias("hash_id"))


@query("h9_haversine", f"SELECT p.place_id, round({_HAV.format(a='p.lat', b='d.lat', c='p.lon', d='d.lon')}, 6) AS km FROM places p JOIN depots d ON d.depot_id = p.place_id % 50 + 1")
def _(v):
    p, d = v.places, v.depots.select("depot_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    return p.join(d, F.col("depot_id") == F.col("place_id") % 50 + 1).select("place_id", F.round(S.haversine_km(F.col("lon"), F.col("lat"), F.col("x"), F.col("y")), 6).alias("km"))


@query("h10_tiers", "SELECT place_id, score, tier, CASE tier WHEN 'major' THEN CAST(0.8 AS DOUBLE) WHEN 'regional' THEN CAST(1.6 AS DOUBLE) ELSE CAST(2.9 AS DOUBLE) END AS min_zoom FROM (SELECT place_id, score, CASE WHEN score >= 3 OR population >= 1500000 THEN 'major' WHEN score >= 2 OR population >= 350000 THEN 'regional' ELSE 'minor' END AS tier FROM (SELECT place_id, population, CASE WHEN place_id % 97 = 0 THEN 3 WHEN place_id % 13 = 0 THEN 2 ELSE 1 END AS score FROM places))")
def _(v):
    kind = F.when(F.col("place_id") % 97 == 0, "country_capital").when(F.col("place_id") % 13 == 0, "admin_capital").otherwise("place")
    p = v.places.withColumn("score", S.capital_score(kind))
    tier = S.base_tier(F.col("population"), F.col("score"))
    return p.select("place_id", "score", tier.alias("tier"), S.min_zoom(tier).alias("min_zoom"))


@query("h11_light_weight", "SELECT place_id, round(greatest(0.18, least(1.0, greatest(0.0, least(1.0, (log10(greatest(population, 1)) - 4.9) / 2)) * 0.72 + CASE WHEN place_id % 13 = 0 THEN 0.1 ELSE 0.0 END)), 9) AS weight FROM places")
def _(v):
    return v.places.select("place_id", F.round(S.light_weight(F.col("population"), F.when(F.col("place_id") % 13 == 0, 0.1).otherwise(0.0)), 9).alias("weight"))


@query("h12_segment_rank", f"SELECT segment_id, CASE WHEN class = 'motorway' THEN 1 WHEN class = 'trunk' AND {_MERC} >= 20000 THEN 2 ELSE 3 END AS rank FROM segments")
def _(v):
    length = S.mercator_length_m(*map(F.col, ("x0", "y0", "x1", "y1")))
    return v.segments.select("segment_id", F.when(F.col("class") == "motorway", 1).when((F.col("class") == "trunk") & (length >= 20000), 2).otherwise(3).alias("rank"))


_TAX = [("steel|copper|tin", "metal"), ("brass|nickel", "alloy"), ("promo", "promo"), ("economy", "economy")]


@query("h13_taxonomy", "SELECT p_partkey, CASE " + " ".join(f"WHEN regexp_matches(lower(p_type), '{r}') THEN '{g}'" for r, g in _TAX) + " ELSE 'other' END AS grp FROM part")
def _(v):
    out = None
    for r, g in _TAX:
        out = F.when(F.lower("p_type").rlike(r), g) if out is None else out.when(F.lower("p_type").rlike(r), g)
    return v.part.select("p_partkey", out.otherwise("other").alias("grp"))


@query("h14_nested_first", "SELECT feature_id, name AS primary_name, CASE WHEN feature_id % 3 = 0 THEN NULL ELSE owner END AS first_ref FROM features")
def _(v):
    nested = v.features.select("feature_id", F.struct(F.col("name").alias("primary")).alias("names"), F.when(F.col("feature_id") % 3 == 0, F.array().cast("array<struct<ref:string>>")).otherwise(F.array(F.struct(F.col("owner").alias("ref")), F.struct(F.lit("x").alias("ref")))).alias("routes"))
    return nested.select("feature_id", F.col("names.primary").alias("primary_name"), F.get("routes", F.lit(0))["ref"].alias("first_ref"))


@query("h15_latest_date_block", "SELECT o_custkey, max(o_orderdate) AS latest, strftime(max(o_orderdate), '%Y.%-m.%-d.0') AS key FROM orders WHERE o_orderdate <= TIMESTAMP '1997-06-01' GROUP BY o_custkey")
def _(v):
    o = v.orders.where("o_orderdate <= TIMESTAMP '1997-06-01'").select("o_custkey", "o_orderdate", F.date_format("o_orderdate", "yyyy.M.d.0").alias("key"))
    best = F.max(F.struct(S.date_key(F.col("key")).alias("k"), "o_orderdate", "key"))
    return o.groupBy("o_custkey").agg(best.alias("b")).select("o_custkey", F.col("b.o_orderdate").alias("latest"), F.col("b.key").alias("key"))


_LIN = "CASE WHEN {0} / 255.0 <= 0.04045 THEN {0} / 255.0 / 12.92 ELSE pow(({0} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(
    "h17_colour_distance",
    f"""WITH c AS (SELECT p_partkey, (p_partkey * 37) % 256 AS r, (p_partkey * 101) % 256 AS g, (p_partkey * 211) % 256 AS b FROM part),
l AS (SELECT p_partkey, {_LIN.format('r')} AS r, {_LIN.format('g')} AS g, {_LIN.format('b')} AS b FROM c),
t AS (SELECT p_partkey, (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047 AS x, r * 0.2126729 + g * 0.7151522 + b * 0.0721750 AS y, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883 AS z FROM l),
f AS (SELECT p_partkey, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16.0 / 116 END AS x, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16.0 / 116 END AS y, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16.0 / 116 END AS z FROM t)
SELECT p_partkey, round(116 * y - 16, 5) AS l, round(500 * (x - y), 5) AS a, round(200 * (y - z), 5) AS b FROM f""",
)
def _(v):
    hexes = F.concat(F.lit("#"), *[F.lpad(F.hex((F.col("p_partkey") * m) % 256), 2, "0") for m in (37, 101, 211)])
    p = v.part.select("p_partkey", hexes.alias("colour"))
    return p.select("p_partkey", *[F.round(x, 5).alias(n) for n, x in zip("lab", S.lab(F.col("colour")), strict=True)])


@query("h18_lenient_casts", "SELECT event_id, coalesce(CAST(trunc(TRY_CAST(trim(CASE WHEN event_id % 7 = 0 THEN event_type ELSE ' ' || value || ' ' END) AS DOUBLE)) AS BIGINT), 0) AS n, CASE event_id % 4 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS flag FROM events")
def _(v):
    t = F.when(F.col("event_id") % 7 == 0, F.col("event_type")).otherwise(F.concat(F.lit(" "), F.col("value").cast("string"), F.lit(" ")))
    b = F.element_at(F.array(F.lit(" True"), F.lit("no"), F.lit("maybe"), F.lit("")), (F.col("event_id") % 4 + 1).cast("int"))
    return v.events.select("event_id", S.to_int(t).alias("n"), S.to_bool(b).alias("flag"))


_LABEL = {"STEEL": "iron", "TIN": "tin", "BRASS": "alloy", "COPPER": "copper", "NICKEL": "nickel"}


@query("h19_code_labels", "SELECT p_partkey, array_to_string(list_transform(string_split(p_type, ' '), lambda x: CASE x " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _LABEL.items()) + " ELSE x END), '|') AS labels FROM part")
def _(v):
    label = lambda x: F.coalesce(*[F.when(x == a, b) for a, b in _LABEL.items()], x)
    return v.part.select("p_partkey", F.array_join(F.transform(F.split("p_type", " "), label), "|").alias("labels"))


@query("h20_mercator_length", f"SELECT segment_id, round({_MERC}, 2) AS length_m FROM segments")
def _(v):
    return v.segments.select("segment_id", F.round(S.mercator_length_m(*map(F.col, ("x0", "y0", "x1", "y1"))), 2).alias("length_m"))


@query("h21_equal_area", f"SELECT zone_id, round((radians(xmax) - radians(xmin)) * ({_Q.format('ymax')} - {_Q.format('ymin')}) * 6378137.0 * 6378137.0 / 2 / 1e6, 3) AS km2 FROM zones")
def _(v):
    return v.zones.select("zone_id", F.round(S.box_area_km2(*map(F.col, ("xmin", "ymin", "xmax", "ymax"))), 3).alias("km2"))


@query("h23_midpoints", "SELECT segment_id, round((x0 + x1) / 2, 9) AS x, round((y0 + y1) / 2, 9) AS y FROM segments")
def _(v):
    return v.segments.select("segment_id", F.round((F.col("x0") + F.col("x1")) / 2, 9).alias("x"), F.round((F.col("y0") + F.col("y1")) / 2, 9).alias("y"))


@query("h24_snap", "SELECT place_id, round(lon * 2) / 2 + 0.0 AS lon, round(lat * 2) / 2 + 0.0 AS lat FROM places")
def _(v):
    return v.places.select("place_id", *[(F.round(F.col(c) * 2) / 2 + 0.0).alias(c) for c in ("lon", "lat")])


@query("h25_bounds", "SELECT home_unit_id, greatest(min(lon), -180.0) AS xmin, greatest(min(lat), -90.0) AS ymin, least(max(lon), 180.0) AS xmax, least(max(lat), 90.0) AS ymax FROM places GROUP BY home_unit_id")
def _(v):
    return v.places.groupBy("home_unit_id").agg(F.greatest(F.min("lon"), F.lit(-180.0)).alias("xmin"), F.greatest(F.min("lat"), F.lit(-90.0)).alias("ymin"), F.least(F.max("lon"), F.lit(180.0)).alias("xmax"), F.least(F.max("lat"), F.lit(90.0)).alias("ymax"))


_WATER = [("ocean", "ocean"), ("sea", "sea"), ("gulf|bay", "gulf"), ("strait|channel", "strait"), ("lake", "lake")]


@query("h30_water_type", "SELECT o_orderkey, CASE " + " ".join(f"WHEN regexp_matches(lower(n), '{r}') THEN '{g}'" for r, g in _WATER) + " ELSE 'water' END AS water_type FROM (SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN 'North Sea ' WHEN 1 THEN 'Bay of ' WHEN 2 THEN 'Lake ' WHEN 3 THEN 'Ocean Lake ' WHEN 4 THEN 'Channel ' ELSE '' END || o_orderpriority AS n FROM orders)")
def _(v):
    n = F.concat(F.expr("CASE o_orderkey % 6 WHEN 0 THEN 'North Sea ' WHEN 1 THEN 'Bay of ' WHEN 2 THEN 'Lake ' WHEN 3 THEN 'Ocean Lake ' WHEN 4 THEN 'Channel ' ELSE '' END"), "o_orderpriority")
    return v.orders.select("o_orderkey", F.coalesce(*[F.when(F.lower(n).rlike(r), g) for r, g in _WATER], F.lit("water")).alias("water_type"))


@query("h32_angular_match", "WITH c AS (SELECT p.place_id, d.depot_id, sqrt(pow((p.lon - d.lon) * cos(radians(p.lat)), 2) + pow(p.lat - d.lat, 2)) AS deg FROM places p, depots d) SELECT place_id, depot_id, round(deg, 9) AS deg FROM (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY deg, depot_id) AS rn FROM c WHERE deg <= 1.5) WHERE rn = 1")
def _(v):
    d = v.depots.select("depot_id", F.col("lon").alias("x"), F.col("lat").alias("y"))
    best = G.nearest(v.places, d, 1.5, 1, "depot_id", "lon", "lat", "x", "y", "deg", degrees=True)
    return v.places.select("place_id", "lon", "lat").join(best, ["lon", "lat"]).select("place_id", "depot_id", F.round("deg", 9).alias("deg"))


@query("h33_tag_lists", "SELECT feature_id, CASE WHEN upper(owner) = upper(controller) THEN [upper(owner)] ELSE [upper(owner), upper(controller)] END AS tags FROM features", lists=("tags",))
def _(v):
    return v.features.select("feature_id", S.tag_list(F.array(F.lower("owner"), F.lit(" "), F.concat(F.lit(" "), "controller"), "owner")).alias("tags"))
