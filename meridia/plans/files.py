"""Queries of sources and sinks (2.A): a layer is written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import geometry as M
from meridia.operators import manifests
from meridia.operators import spatial as G
from meridia.sources import files as R
from meridia.sources.shared import shared

from .joins import BOX
from .registry import query

_GAZ = "SELECT place_id, name, population, lon, lat, CASE place_id % 50 WHEN 0 THEN 'PPLC' WHEN 1 THEN 'PPLA' ELSE 'PPL' END AS code, CASE WHEN place_id % 20 = 0 THEN 'x1' ELSE 'fr' END AS cc FROM places"


def gazetteer_file(v) -> str:
    path = shared(v.spark, "gazetteer")
    v.places.createOrReplaceTempView("gazetteer_places")
    p = v.spark.sql(_GAZ.replace("FROM places", "FROM gazetteer_places"))
    given = {"geonameid": "place_id", "name": "name", "asciiname": "name", "latitude": "lat", "longitude": "lon", "feature_code": "code", "country_code": "cc", "population": "population"}
    cols = [F.col(given[c]).cast("string").alias(c) if c in given else F.lit("NA" if c == "timezone" else "a, b" if c == "alternatenames" else "").alias(c) for c in R.GAZETTEER]
    p.select(*cols).write.option("sep", "\t").option("quote", "").option("emptyValue", "").csv(path)
    return path


@query("a1_gazetteer_scan", f"SELECT CAST(place_id AS VARCHAR) AS geonameid, name, 'NA' AS timezone, CAST(population AS VARCHAR) AS population FROM ({_GAZ})")
def _(v):
    return R.read_gazetteer(v.spark, gazetteer_file(v)).select("geonameid", "name", "timezone", "population")


@query(
    "a2_gazetteer_normalise",
    f"SELECT 'CITY::gn::' || place_id AS id, 'FR' AS country_code, population, kind, CASE WHEN kind = 'country_capital' OR population >= 1500000 THEN 'major' WHEN kind = 'admin_capital' OR population >= 350000 THEN 'regional' ELSE 'minor' END AS base_tier FROM (SELECT *, CASE code WHEN 'PPLC' THEN 'country_capital' WHEN 'PPLA' THEN 'admin_capital' ELSE 'place' END AS kind FROM ({_GAZ})) WHERE cc = 'fr' AND population >= 15000",
)
def _(v):
    return R.normalise_gazetteer(R.read_gazetteer(v.spark, gazetteer_file(v))).select("id", "country_code", "population", F.col("capital_kind").alias("kind"), "base_tier")


@query("a4_segment_scan", "SELECT segment_id, class FROM segments WHERE class IN ('motorway', 'trunk') AND x1 >= -20 AND x0 < 40 AND y1 >= 30 AND y0 < 60")
def _(v):
    path = shared(v.spark, "segments")
    box = F.struct(F.col("x0").alias("xmin"), F.col("x1").alias("xmax"), F.col("y0").alias("ymin"), F.col("y1").alias("ymax"))
    v.segments.select("segment_id", "class", F.lit("road").alias("subtype"), box.alias("bbox")).write.parquet(path)
    return R.read_segments(v.spark, path, "road", ["motorway", "trunk"], (-20, 30, 40, 60)).select("segment_id", "class")


@query("a5_geojson_round_trip", "SELECT CAST(zone_id AS VARCHAR) AS zone_id, xmin, ymax FROM zones")
def _(v):
    path = shared(v.spark, "geojson")
    R.write_geojson(v.zones.select("zone_id", G.box_rings(*BOX).alias("rings")), path, "rings", ["zone_id"])
    xmin, _, _, ymax = G.bounds(F.col("rings"))
    return R.read_geojson(v.spark, path, ["zone_id"]).select("zone_id", xmin.alias("xmin"), ymax.alias("ymax"))


@query("a5_multi_part_features", "SELECT CAST(zone_id AS VARCHAR) AS zone_id, CASE WHEN zone_id % 3 = 0 THEN 2 ELSE 1 END AS parts, round((xmax - xmin) * (ymax - ymin) - CASE WHEN zone_id % 3 = 0 THEN 2 * (ymax - ymin) ELSE 0 END, 6) AS area FROM zones")
def _(v):
    # Every third zone is cut in two parts with a gap of 2 degrees, as a MultiPolygon.
    path, mid = shared(v.spark, "geojson"), (F.col("xmin") + F.col("xmax")) / 2
    z = v.zones.withColumns({"left": mid - 1, "right": mid + 1})
    parts = F.when(F.col("zone_id") % 3 == 0, F.array(G.box_rings("xmin", "ymin", "left", "ymax"), G.box_rings("right", "ymin", "xmax", "ymax"))).otherwise(F.array(G.box_rings(*BOX)))
    R.write_geojson(z.select("zone_id", parts.alias("parts")), path, "parts", ["zone_id"], parts=True)
    own = F.aggregate("parts", F.lit(0.0), lambda a, p: a + M.area(p))
    return R.read_geojson(v.spark, path, ["zone_id"]).select("zone_id", F.size("parts").alias("parts"), F.round(own, 6).alias("area"))


@query("a7_keyed_map_scan", "SELECT CAST(feature_id AS VARCHAR) AS id, upper(owner) AS tag FROM features WHERE feature_id % 10 <> 0")
def _(v):
    path = shared(v.spark, "owners")
    tag = F.when(F.col("feature_id") % 10 == 0, "  ").otherwise(F.concat(F.lit(" "), F.lower("owner")))
    # A document holds at most a thousand features of a unit, those of 25,000 successive ids, however many it has; the reader takes any number of files.
    files = v.features.groupBy("unit_id", F.floor(F.col("feature_id") / 25_000)).agg(F.map_from_entries(F.collect_list(F.struct(F.col("feature_id").cast("string"), tag))).alias("owners"))
    files.select("owners").write.option("maxRecordsPerFile", 1).json(path)
    return R.read_keyed_map(v.spark, path, "owners")


@query("a8_hierarchy_scan", "SELECT CAST(group_id AS VARCHAR) AS group_id, CAST(row_number() OVER (PARTITION BY group_id ORDER BY unit_id) - 1 AS INTEGER) AS pos, CAST(unit_id AS VARCHAR) AS child_id FROM units")
def _(v):
    path = shared(v.spark, "hierarchy")
    groups = v.units.groupBy("group_id").agg(F.transform(F.sort_array(F.collect_list("unit_id")), lambda x: x.cast("string")).alias("c"))
    groups.select(F.create_map(F.col("group_id").cast("string"), "c").alias("groups")).write.option("maxRecordsPerFile", 1).json(path)
    return R.read_hierarchy(v.spark, path)


@query("a9_rules_scan", "SELECT 'r' || s_suppkey AS rule_id, CAST(s_nationkey AS INTEGER) AS priority, ['u' || s_nationkey] AS include FROM supplier WHERE s_suppkey % 4 <> 0", lists=("include",))
def _(v):
    path = shared(v.spark, "rules")
    quality = F.when(F.col("s_suppkey") % 4 == 0, "unknown").otherwise("manual")
    v.supplier.select(F.concat(F.lit("r"), "s_suppkey").alias("rule_id"), F.col("s_nationkey").alias("priority"), quality.alias("quality"), F.array(F.concat(F.lit("u"), "s_nationkey")).alias("include")).write.json(path)
    return R.read_rules(v.spark, path).select("rule_id", "priority", "include")


@query("a10_delimited_scan", "SELECT p_partkey AS id, CAST(p_size AS INTEGER) AS r, p_size % 2 = 0 AS coastal FROM part")
def _(v):
    path = shared(v.spark, "definition")
    v.part.select("p_partkey", "p_size", F.when(F.col("p_size") % 2 == 0, "true").otherwise("false")).write.option("sep", ";").csv(path)
    return v.spark.read.schema("id long, r int, coastal boolean").option("sep", ";").csv(path)


@query("a12_provenance_counts", "SELECT o_orderstatus AS member, count(*) AS n, count(*) FILTER (WHERE o_totalprice > 100000) AS kept FROM orders GROUP BY o_orderstatus")
def _(v):
    path = shared(v.spark, "members")
    v.orders.select("o_orderstatus", "o_totalprice").write.partitionBy("o_orderstatus").parquet(path)
    rows = v.spark.read.parquet(path).withColumn("file", F.col("_metadata.file_path"))
    per_file = rows.groupBy("file", "o_orderstatus").agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 100000).alias("kept"))
    return per_file.groupBy(F.col("o_orderstatus").alias("member")).agg(F.sum("n").alias("n"), F.sum("kept").alias("kept"))


@query("a14_chunked_products", "SELECT class, count(*) AS n FROM segments WHERE class <> 'unknown' GROUP BY class")
def _(v):
    path = shared(v.spark, "chunks")
    v.segments.write.option("maxRecordsPerFile", 5000).parquet(path)
    chunks = v.spark.read.parquet(path)
    return chunks.where("class = 'motorway'").select("class").union(chunks.where("class = 'trunk'").select("class")).groupBy("class").agg(F.count("*").alias("n"))


@query("a15_shard_catalog", "SELECT CASE WHEN (x0 + x1) / 2 >= -180 AND (x0 + x1) / 2 < 180 THEN 'lon_' || CAST(floor(((x0 + x1) / 2 + 180) / 10) AS INTEGER) ELSE 'low_priority' END AS shard_id, count(*) AS features FROM segments GROUP BY 1")
def _(v):
    return R.write_shards(v.segments, shared(v.spark, "shards"), (F.col("x0") + F.col("x1")) / 2)


@query(
    "a16_tile_manifest",
    """WITH l AS (SELECT *, unnest([1, 2]) AS lod FROM zones), x AS (SELECT *, unnest(range(least(CAST(floor((xmin + 180) / (90.0 / lod)) AS INT), 4 * lod - 1), least(CAST(floor((xmax + 180) / (90.0 / lod)) AS INT), 4 * lod - 1) + 1)) AS tx FROM l),
t AS (SELECT *, unnest(range(least(CAST(floor((ymin + 90) / (90.0 / lod)) AS INT), 2 * lod - 1), least(CAST(floor((ymax + 90) / (90.0 / lod)) AS INT), 2 * lod - 1) + 1)) AS ty FROM x)
SELECT lod, tx || '_' || ty AS tile, count(*) AS feature_count, min(xmin) AS xmin, min(ymin) AS ymin, max(xmax) AS xmax, max(ymax) AS ymax FROM t GROUP BY lod, tx, ty""",
)
def _(v):
    return R.write_tiles(v.zones, shared(v.spark, "tiles"), *BOX)


@query("a18_output_manifest", "SELECT 'places' AS role, count(*) AS n FROM places UNION ALL SELECT 'zones', count(*) FROM zones UNION ALL SELECT 'segments', count(*) FROM segments")
def _(v):
    spec = {}
    for role in ("places", "zones", "segments"):
        path = shared(v.spark, role)
        getattr(v, role).write.parquet(path)
        spec[role] = path, "derived", 1
    return manifests.output_manifest(v.spark, spec).select("role", F.col("feature_count").alias("n"))


@query("a18_manifest_artifacts", "SELECT 'places' AS role, 'publish' AS artifact_class, count(*) AS feature_count, TRUE AS whole FROM places UNION ALL SELECT 'zones', 'derived', count(*), TRUE FROM zones UNION ALL SELECT 'segments', 'derived', count(*), TRUE FROM segments")
def _(v):
    # Each layer is written; its row tells files, bytes and a digest of all files, which differ from run to run by the files' names and sizes.
    spec = {}
    for role, kind in (("places", "publish"), ("zones", "derived"), ("segments", "derived")):
        path = shared(v.spark, role)
        getattr(v, role).write.parquet(path)
        spec[role] = path, kind, 2
    m = manifests.output_manifest(v.spark, spec)
    whole = (F.col("files") > 0) & (F.col("bytes") > 0) & F.col("sha256").rlike("^[0-9a-f]{64}$")
    return m.select("role", "artifact_class", "feature_count", whole.alias("whole"))


@query("a19_source_ledger", "SELECT o_orderstatus AS consumer, count(*) AS n, 0 AS unhashed FROM orders GROUP BY o_orderstatus")
def _(v):
    path = shared(v.spark, "ledger")
    v.orders.select("o_orderkey", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    rows = R.with_provenance(v.spark.read.parquet(path)).groupBy("source_member", F.col("o_orderstatus").alias("consumer")).agg(F.count("*").alias("n"))
    hashes = R.file_ledger(v.spark, path).select(F.col("name").alias("source_member"), "sha256").distinct()
    known = rows.join(hashes.groupBy("source_member").agg(F.count("sha256").alias("hashes")), "source_member", "left")
    return known.groupBy("consumer").agg(F.sum("n").alias("n"), F.count_if(F.col("hashes").isNull()).alias("unhashed"))
