"""Queries of operators that take several rounds or formats of their own (2.A, 2.D, 2.E, 2.G, 2.H, 2.I, 2.M)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from meridia.functions import scalars as S
from meridia.operators import graph, ranking
from meridia.operators import spatial as G
from meridia.sources import files as R
from meridia.sources.shared import scratch, shared

from .joins import BOX, BOX2, _MEET, second
from .registry import query


@query("a3_source_b_normalise", "SELECT 'CITY::ne::' || CASE WHEN place_id % 9 = 0 THEN upper(substr(sha1(home_unit_id || '|' || name || '|' || CAST(CAST(lon * 100 AS BIGINT) AS VARCHAR)), 1, 12)) ELSE CAST(place_id AS VARCHAR) END AS id, CASE WHEN place_id % 4 = 0 THEN 'country_capital' ELSE 'place' END AS kind FROM gazetteer_b WHERE place_id % 5 <> 0")
def _(v):
    raw = v.gazetteer_b.select(F.when(F.col("place_id") % 9 != 0, F.col("place_id").cast("string")).alias("ne_id"), "home_unit_id", "name", "lon", F.when(F.col("place_id") % 5 == 0, "Meteorological Station").when(F.col("place_id") % 4 == 0, "Admin-0 capital").otherwise("Populated place").alias("featurecla"))
    kind = F.when(F.lower("featurecla").isin("admin-0 capital", "admin-0 capital alt"), "country_capital").when(F.lower("featurecla").contains("capital"), "admin_capital").otherwise("place")
    own = S.stable_hash(F.col("home_unit_id"), F.col("name"), F.round(F.col("lon") * 100).cast("long"))
    return raw.where("featurecla IN ('Admin-0 capital', 'Populated place')").select(F.concat(F.lit("CITY::ne::"), F.coalesce("ne_id", own)).alias("id"), kind.alias("kind"))


@query("a6_topology_scan", "SELECT CAST(zone_id AS VARCHAR) AS zone_id, round(xmin, 4) AS xmin, round(ymin, 4) AS ymin, round(xmax, 4) AS xmax, round(ymax, 4) AS ymax FROM zones")
def _(v):
    # Topologies of up to 64 zones, each a file; every zone has two arcs of its own, and every fifth is a MultiPolygon that has its ring twice.
    path = shared(v.spark, "topology")
    d = lambda *p: F.array(*[F.expr(x).cast("double") for x in p])
    nth = F.row_number().over(Window.partitionBy("doc").orderBy("zone_id")) - 1
    z = v.zones.withColumn("doc", F.floor(F.col("zone_id") / 64)).withColumn("nth", nth)
    arcs = F.array(F.array(d("(xmin + 180) * 100", "(ymin + 90) * 100"), d("3000", "0"), d("0", "2000")), F.array(d("(xmin + 180) * 100", "(ymin + 90) * 100"), d("0", "2000"), d("3000", "0")))
    ring = F.array(2 * F.col("nth"), -2 - 2 * F.col("nth"))
    many = F.col("zone_id") % 5 == 0
    shape = F.when(many, F.to_json(F.array(F.array(ring), F.array(ring)))).otherwise(F.to_json(F.array(ring)))
    text = lambda form, *c: F.format_string(form, *c)
    geometry = text('{"type":"%s","arcs":%s,"properties":{"zone_id":"%s"}}', F.when(many, "MultiPolygon").otherwise("Polygon"), shape, F.col("zone_id"))
    docs = z.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("nth", geometry.alias("g"), F.to_json(arcs).alias("a")))).alias("m"))
    inner = F.transform("m.a", lambda a: F.substr(a, F.lit(2), F.length(a) - 2))
    docs.select(text('{"transform":{"scale":[0.01,0.01],"translate":[-180,-90]},\n "arcs":[%s],\n "objects":{"political":{"geometries":[%s]}}}', F.array_join(inner, ",\n"), F.array_join("m.g", ",\n"))).write.option("maxRecordsPerFile", 1).text(path)
    box = G.bounds(F.col("rings"))
    return R.read_topology(v.spark, path, "political", ["zone_id"]).select("zone_id", *[F.round(b, 4).alias(n) for b, n in zip(box, BOX, strict=True)])


@query("a11_code_page_scan", "SELECT p_partkey AS id, '鉱山 ' || p_name AS name FROM part")
def _(v):
    path = shared(v.spark, "cp932")
    v.spark.conf.set("spark.sql.legacy.javaCharsets", "true")  # else Spark takes UTF and ISO 8859-1 only
    v.part.select("p_partkey", F.concat(F.lit("  鉱山 "), "p_name", F.lit(" "))).write.option("encoding", "windows-31j").csv(path)
    return R.read_code_page_csv(v.spark, path, "id long, name string", "windows-31j")


@query("a13_pixel_scan", "SELECT r, c, -180 + (c + 0.5) * 360.0 / 128 AS lon, 90 - (r + 0.5) * 180.0 / 64 AS lat, value FROM pixels WHERE r >= 16 AND r < 32")
def _(v):
    path = shared(v.spark, "pixels")
    v.pixels.withColumn("row_block", F.floor(F.col("r") / 16)).write.partitionBy("row_block").parquet(path)
    p = v.spark.read.parquet(path).where("row_block = 1")
    return p.select("r", "c", (-180 + (F.col("c") + 0.5) * 360.0 / 128).alias("lon"), (90 - (F.col("r") + 0.5) * 180.0 / 64).alias("lat"), "value")


_RUNS = "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem"


@query("d10_line_merge", f"SELECT l_orderkey, min(l_linenumber) AS first, count(*) AS segments FROM (SELECT *, l_linenumber - row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS run FROM ({_RUNS})) GROUP BY l_orderkey, run")
def _(v):
    s = v.lineitem.select("l_orderkey", "l_linenumber").distinct().withColumn("id", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    line = graph.merge_lines(s.withColumn("next", F.col("l_linenumber") + 1), "id", ["l_orderkey"], "l_linenumber", "next")
    return line.groupBy("line").agg(F.count("*").alias("segments")).select(F.floor(F.col("line") / 100).alias("l_orderkey"), (F.col("line") % 100).alias("first"), "segments")


@query(
    "e12_scaled_threshold",
    """WITH RECURSIVE w AS (SELECT home_unit_id AS k, CAST(sum(population) AS DOUBLE) AS w FROM places GROUP BY 1),
b AS (SELECT 0 AS i, CAST(0 AS DOUBLE) AS lo, CAST(6000 AS DOUBLE) / (SELECT sum(w) FROM w) AS hi UNION ALL SELECT i + 1, CASE WHEN s < 300 THEN mid ELSE lo END, CASE WHEN s < 300 THEN hi ELSE mid END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS mid, sum(least(60, greatest(1, round(w.w * ((lo + hi) / 2))))) AS s FROM b, w WHERE i < 60 GROUP BY i, lo, hi)),
n AS (SELECT k, w, CAST(least(60, greatest(1, round(w * hi))) AS INTEGER) AS seats FROM w, b WHERE i = 60), o AS (SELECT CAST(sum(seats) AS INTEGER) - 300 AS miss FROM n),
st AS (SELECT k, w, seats, miss, unnest(CASE WHEN miss < 0 AND seats < 60 THEN range(seats + 1, 61) WHEN miss > 0 AND seats > 1 THEN range(seats, 1, -1) ELSE CAST([] AS BIGINT[]) END) AS step FROM n, o),
r AS (SELECT k, miss, row_number() OVER (ORDER BY CASE WHEN miss < 0 THEN w / step WHEN w > 0 THEN step / w ELSE CAST('infinity' AS DOUBLE) END DESC, k, abs(step - seats)) AS rn FROM st),
c AS (SELECT k, count(*) * -sign(any_value(miss)) AS change FROM r WHERE rn <= abs(miss) GROUP BY k)
SELECT n.k AS home_unit_id, CAST(seats + coalesce(change, 0) AS INTEGER) AS seats FROM n LEFT JOIN c USING (k)""",
)
def _(v):
    w = v.places.groupBy("home_unit_id").agg(F.sum("population").cast("double").alias("w"))
    return ranking.scaled_seats(w, "home_unit_id", "w", 300, 60)


@query("g21_border_detail", f"SELECT a.zone_id FROM zones a WHERE NOT EXISTS (SELECT 1 FROM units b WHERE b.unit_id = 7 AND {_MEET.format('a', 'b')}) UNION ALL SELECT 1000 + unit_id FROM units WHERE unit_id = 7")
def _(v):
    country = v.units.where("unit_id = 7")
    hit = G.box_pairs(v.zones, second(country, unit_id="unit_id"), BOX, BOX2).select("zone_id")
    return v.zones.select("zone_id").join(hit, "zone_id", "left_anti").unionByName(country.select((F.col("unit_id") + 1000).alias("zone_id")))


@query("h16_nested_keys", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def _(v):
    return v.events.select("event_id", F.get(R.nested_lists(F.col("props"), "k"), F.lit(0)).alias("k"))


@query("i2_id_reuse", "WITH m AS (SELECT DISTINCT feature_id % 40 AS o, CASE WHEN feature_id % 40 < 20 THEN feature_id % 40 WHEN feature_id % 40 < 30 THEN 100 + feature_id % 80 ELSE 200 + feature_id % 5 END AS n FROM features), s AS (SELECT o, count(*) AS children FROM m GROUP BY o), p AS (SELECT n, count(*) AS parents, min(o) AS o FROM m GROUP BY n) SELECT p.n, CASE WHEN parents > 1 THEN 'new_' || p.n WHEN children = 1 THEN CAST(p.o AS VARCHAR) ELSE p.o || '__' || (SELECT count(*) FROM m WHERE m.o = p.o AND m.n <= p.n) END AS id FROM p JOIN s ON s.o = p.o")
def _(v):
    old = F.col("feature_id") % 40
    new = F.when(old < 20, old).when(old < 30, 100 + F.col("feature_id") % 80).otherwise(200 + F.col("feature_id") % 5)
    return graph.reuse_ids(v.features.select(old.alias("o"), new.alias("n")), "o", "n")


def _places(v):
    """Zones with the first of their place, and pairs (src, dst) of places that meet: equal zones meet one another and the same others."""
    zones = scratch(v.zones.select(*BOX, "zone_id", F.min("zone_id").over(Window.partitionBy(*BOX)).alias("first")), "zones")
    one = zones.where("zone_id = first").select(*BOX, F.col("first").alias("src"))
    pairs = G.box_pairs(one, second(one, src="dst"), BOX, BOX2, per=2).where("src < dst")
    return zones, pairs.select("src", "dst")


@query("i6_colouring")
def _(v):
    zones, pairs = _places(v)
    return graph.greedy_colours(zones.select(F.col("zone_id").alias("id"), "first"), pairs, same="first")


#: The colours of the query's palette, by place.
PALETTE = ("#e6194b", "#3cb44b", "#ffe119", "#4363d8", "#f58231", "#911eb4", "#46f0f0", "#f032e6", "#bcf60c", "#fabebe", "#008080", "#e6beff", "#9a6324", "#800000", "#808000", "#000075")


@query("i6_palette_colouring")
def _(v):
    # Zones with a number that 50 divides have a fixed colour.
    zones, pairs = _places(v)
    nodes = zones.select(F.col("zone_id").alias("id"), "first", F.when(F.col("zone_id") % 50 == 0, PALETTE[0]).alias("fixed"))
    return graph.palette_colours(nodes, pairs, v.spark.createDataFrame(list(enumerate(PALETTE)), "place int, colour string"), same="first")


@query("m1_product_builder", "SELECT class, count(*) AS n, round(sum(x1 - x0), 4) AS width FROM segments GROUP BY class")
def _(v):
    path = shared(v.spark, "chunks")
    v.segments.select("class", "x0", "x1").write.parquet(path)
    builder = lambda rows, chunk: rows.groupBy(chunk, "class").agg(F.count("*").alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("width"))
    return R.build_by_chunks(v.spark.read.parquet(path), builder).groupBy("class").agg(F.sum("n").alias("n"), F.round(F.sum("width"), 4).alias("width"))


@query("m1_chunk_products", "SELECT class, count(*) AS n, round(sum(x1 - x0), 4) AS width, TRUE AS bounded FROM segments GROUP BY class")
def _(v):
    # Chunks of at most 5000 segments; a product is a row for each chunk and class.
    path = shared(v.spark, "chunks")
    v.segments.select("class", "x0", "x1").write.option("maxRecordsPerFile", 5000).parquet(path)
    builder = lambda rows, chunk: rows.groupBy(chunk, "class").agg(F.count("*").alias("n"), F.sum(F.col("x1") - F.col("x0")).alias("width"))
    products = R.build_by_chunks(v.spark.read.parquet(path), builder)
    return products.groupBy("class").agg(F.sum("n").alias("n"), F.round(F.sum("width"), 4).alias("width"), (F.max("n") <= 5000).alias("bounded"))


@query(
    "i4_contiguous_parts",
    f"""WITH RECURSIVE e AS (SELECT a.unit_id AS x, b.unit_id AS y FROM units a JOIN units b ON a.group_id = b.group_id AND a.unit_id <> b.unit_id AND {_MEET.format('a', 'b')}),
s AS (SELECT unit_id FROM (SELECT unit_id, row_number() OVER (PARTITION BY group_id ORDER BY xmin, unit_id) AS rn FROM units) WHERE rn = 1),
r AS (SELECT unit_id, 0 AS level FROM s UNION SELECT e.y, r.level + 1 FROM r JOIN e ON e.x = r.unit_id WHERE r.level < 12),
l AS (SELECT unit_id, min(level) AS level FROM r GROUP BY unit_id)
SELECT u.unit_id AS id, l.level, CAST((row_number() OVER (PARTITION BY u.group_id ORDER BY l.level NULLS LAST, u.xmin, u.unit_id) - 1) // 2 AS INTEGER) AS part FROM units u LEFT JOIN l USING (unit_id)""",
)
def _(v):
    pairs = G.box_pairs(v.units.withColumnRenamed("unit_id", "src"), second(v.units, unit_id="dst"), BOX, BOX2).where("src < dst")
    return graph.grow_parts(v.units.withColumnRenamed("unit_id", "id"), pairs.select("src", "dst"), "group_id", "xmin", 2)


_SNAP = "SELECT zone_id, zone_id % 7 AS country, round(xmin / 25) * 25 + 0.0 AS sx0, round(ymin / 25) * 25 + 0.0 AS sy0, round(xmax / 25) * 25 + 0.0 AS sx1, round(ymax / 25) * 25 + 0.0 AS sy1, xmin, ymin FROM zones"


@query("m3_canonical_boundaries", f"WITH s AS ({_SNAP}), c AS (SELECT country, count(*) FILTER (WHERE sx0 = sx1 OR sy0 = sy1) AS lost FROM s GROUP BY country) SELECT zone_id, CASE WHEN lost = 0 THEN sx0 ELSE xmin END AS x, CASE WHEN lost = 0 THEN sy0 ELSE ymin END AS y, CASE WHEN lost = 0 THEN 'snapped' ELSE 'would lose features' END AS reason FROM s JOIN c USING (country)")
def _(v):
    # Corners snap to a grid; a country keeps its own where a feature would collapse.
    snap = lambda c: F.round(F.col(c) / 25) * 25 + 0.0
    s = v.zones.select("zone_id", (F.col("zone_id") % 7).alias("country"), *[snap(c).alias("s" + c) for c in BOX], "xmin", "ymin")
    lost = s.groupBy("country").agg(F.count_if(F.expr("sxmin = sxmax OR symin = symax")).alias("lost"))
    ok = F.col("lost") == 0
    return s.join(lost, "country").select("zone_id", F.when(ok, F.col("sxmin")).otherwise(F.col("xmin")).alias("x"), F.when(ok, F.col("symin")).otherwise(F.col("ymin")).alias("y"), F.when(ok, "snapped").otherwise("would lose features").alias("reason"))


@query("f3_scan_limit", "SELECT least(count(*), 500) AS n, count(*) > 500 AS more FROM segments")
def _(v):
    # As many rows as were asked for and one more, to tell whether the scan was cut; which rows is left to the scan.
    return v.segments.limit(501).agg(F.least(F.count("*"), F.lit(500)).alias("n"), (F.count("*") > 500).alias("more"))


@query("a17_feature_sink", "SELECT place_id, name, population FROM places")
def _(v):
    path = shared(v.spark, "features")
    v.places.select(F.to_json(F.struct("place_id", "name", "population")).alias("value")).write.text(path)
    return v.spark.read.text(path).select(F.from_json("value", "place_id long, name string, population long").alias("f")).select("f.*")
