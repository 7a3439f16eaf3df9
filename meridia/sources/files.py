"""Readers and writers of the map formats: gazetteers, segments, GeoJSON, keyed maps, rules, tiles, catalogs, manifests.

Every reader declares its schema; nothing is inferred. Writers write partitioned data sets with Spark's committers.
"""

from __future__ import annotations

import fnmatch
import io
import zipfile
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from meridia.functions import scalars as S

from .shared import scratch

# The columns of the gazetteer format, in order.
GAZETTEER = "geonameid name asciiname alternatenames latitude longitude feature_class feature_code country_code cc2 admin1_code admin2_code admin3_code admin4_code population elevation dem timezone modification_date".split()
#: Coordinates and arcs are read as text, as their depth depends on the type of geometry.
FEATURE = "id string, properties map<string,string>, geometry struct<type:string,coordinates:string>"
PAIRS, POINTS = "array<array<array<double>>>", "array<struct<x:double,y:double>>"
RULE = "rule_id string, priority int, quality string, tag string, include array<string>, exclude array<string>, countries array<string>, not_countries array<string>, groups array<string>, not_groups array<string>"


def read_gazetteer(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text, all columns strings, quotes are plain characters and nothing stands for null but nothing."""
    return spark.read.schema(", ".join(f"{c} string" for c in GAZETTEER)).option("sep", "\t").option("quote", "").option("nullValue", "\0").option("emptyValue", "").csv(path)


def normalise_gazetteer(raw: DataFrame, least: int = 15000) -> DataFrame:
    """Places with a valid country code, coordinates and enough people; ids, aliases, capital kind, tier and zoom derived."""
    code = F.upper(F.trim("feature_code"))
    kind = F.when(code == "PPLC", "country_capital").when(code.isin("PPLA", "PPLA2", "PPLA3", "PPLA4"), "admin_capital").otherwise("place")
    out = raw.select(
        F.concat(F.lit("CITY::gn::"), F.trim("geonameid")).alias("id"), S.clean(F.col("name")).alias("name"), F.upper(F.trim("country_code")).alias("country_code"), S.to_int(F.col("population")).alias("population"),
        F.trim("longitude").try_cast("double").alias("lon"), F.trim("latitude").try_cast("double").alias("lat"), kind.alias("capital_kind"), S.alias_split(F.coalesce("alternatenames", F.lit(""))).alias("aliases"),
    )
    tier = S.base_tier(F.col("population"), S.capital_score(F.col("capital_kind")))
    return out.where(F.col("country_code").rlike("^[A-Z]{2}$") & (F.col("population") >= least) & F.col("lon").isNotNull() & F.col("lat").isNotNull()).withColumn("base_tier", tier).withColumn("min_zoom", S.min_zoom(F.col("base_tier")))


def read_segments(spark: SparkSession, path: str, subtype: str, classes: list[str], box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Segments of a subtype and of some classes whose box meets the half-open bounds; all tests reach the Parquet scan."""
    out = spark.read.parquet(path).where((F.col("subtype") == subtype) & F.col("class").isin(classes))
    if box:
        out = out.where((F.col("bbox.xmax") >= box[0]) & (F.col("bbox.xmin") < box[2]) & (F.col("bbox.ymax") >= box[1]) & (F.col("bbox.ymin") < box[3]))
    return out


def write_geojson(df: DataFrame, path: str, shape: str, properties: list[str], parts: bool = False, id_col: str | None = None) -> None:
    """One feature a line; null properties are left out, and so is a null id. shape is a column of rings or, with parts, of polygons (arrays of rings), an array of
    lines where it is named lines, or of points where it is named points; of several a Multi geometry is made, null is no geometry."""
    xy = lambda p: F.array(p["x"], p["y"])
    line = lambda r: F.transform(r, xy)
    polygon = lambda rings: F.transform(rings, line)
    props = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(c).alias("k"), F.col(c).cast("string").alias("v")) for c in properties]), lambda e: e["v"].isNotNull()))
    head = [F.lit("Feature").alias("type"), *([F.col(id_col).cast("string").alias("id")] if id_col else []), props.alias("properties")]
    feature = lambda kind, c: F.to_json(F.struct(*head, F.struct(F.lit(kind).alias("type"), c.alias("coordinates")).alias("geometry")))
    kind, one = ("Polygon", polygon) if parts else ("LineString", line) if shape == "lines" else ("Point", xy) if shape == "points" else (None, None)
    if kind:
        text = F.when(F.size(shape) == 1, feature(kind, one(F.get(shape, F.lit(0))))).otherwise(feature(f"Multi{kind}", F.transform(shape, one)))
    else:
        text = feature("Polygon", polygon(F.col(shape)))
    df.select(F.when(F.col(shape).isNull(), F.to_json(F.struct(*head))).otherwise(text)).write.text(path)


def polygon_parts(kind: Column, coordinates: Column, pair: str = PAIRS) -> Column:
    """Text of a Polygon's or MultiPolygon's coordinates (or arcs) to an array of polygons; null for other geometries."""
    return F.when(kind == "Polygon", F.array(F.from_json(coordinates, pair))).when(kind == "MultiPolygon", F.from_json(coordinates, f"array<{pair}>"))


def line_lists(kind: Column, coordinates: Column, item: str = "array<double>") -> Column:
    """Text of a LineString's or MultiLineString's coordinates (or arcs) to an array of lines; null for other geometries."""
    return F.when(kind == "LineString", F.array(F.from_json(coordinates, f"array<{item}>"))).when(kind == "MultiLineString", F.from_json(coordinates, f"array<array<{item}>>"))


def point_list(kind: Column, coordinates: Column) -> Column:
    """Text of a Point's or MultiPoint's coordinates to an array of positions; null for other geometries."""
    return F.when(kind == "Point", F.array(F.from_json(coordinates, "array<double>"))).when(kind == "MultiPoint", F.from_json(coordinates, "array<array<double>>"))


def _features(rows: DataFrame, properties: list[str], id_col: str | None) -> DataFrame:
    xy = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    parts = F.transform(polygon_parts(kind, text), lambda polygon: F.transform(polygon, xy))
    own = [F.col("id").alias(id_col)] if id_col else []
    out = rows.select(*own, *[F.try_element_at("properties", F.lit(c)).alias(c) for c in properties], kind.alias("geometry_type"), parts.alias("parts"), F.transform(line_lists(kind, text), xy).alias("lines"), xy(point_list(kind, text)).alias("points"))
    return out.withColumn("rings", F.flatten("parts"))


def read_geojson(spark: SparkSession, path: str, properties: list[str], collection: bool = False, id_col: str | None = None) -> DataFrame:
    """Features, one a line or (collection) as one FeatureCollection a file: properties as string columns, geometry_type, and by type parts (an
    array of polygons, each an array of rings) with rings (those of all parts), lines or points; what a type does not have is null, and so is all of a
    geometry collection. id_col: a column for the features' own ids, as text. Text that is no JSON is an error."""
    reader = spark.read.schema(f"features array<struct<{FEATURE}>>" if collection else FEATURE)
    rows = reader.option("multiLine", collection).option("mode", "FAILFAST").json(path)
    return _features(rows.select(F.explode("features").alias("f")).select("f.*") if collection else rows, properties, id_col)


def read_crs(spark: SparkSession, path: str) -> DataFrame:
    """(file, crs): the name of the coordinate system of each FeatureCollection; without one that of longitude and latitude, which the format says then."""
    rows = spark.read.schema("crs struct<properties:struct<name:string>>").option("multiLine", True).option("mode", "FAILFAST").json(path)
    return rows.select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("file"), F.coalesce("crs.properties.name", F.lit("urn:ogc:def:crs:OGC:1.3:CRS84")).alias("crs"))


def read_zipped_geojson(spark: SparkSession, path: str, member: str, properties: list[str]) -> DataFrame:
    """Features of the FeatureCollections in zip archives at path, those members whose name fits the pattern (as of a shell); a task holds a member at a time.
    An archive without such a member is an error, and so is one of 2 GB or more: an archive is one value in a task."""

    def unpack(batches):
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = sorted(n for n in z.namelist() if fnmatch.fnmatch(n, member))
                    if not names:
                        raise ValueError(f"no member of the archive is named like {member}")
                    for n in names:
                        yield pd.DataFrame({"text": [z.read(n).decode("utf-8-sig")]})

    texts = spark.read.format("binaryFile").load(path).select("content").mapInPandas(unpack, "text string")
    whole = F.from_json("text", f"features array<struct<{FEATURE}>>", {"mode": "FAILFAST"})
    return _features(texts.select(F.explode(whole["features"]).alias("f")).select("f.*"), properties, None)


def read_keyed_map(spark: SparkSession, path: str, field: str) -> DataFrame:
    """{field: {id: tag}} to (id, tag): trimmed, upper case, blanks dropped. Text that is no JSON is an error."""
    rows = spark.read.schema(f"{field} map<string,string>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode(field).alias("id", "tag"))
    return rows.select(F.trim("id").alias("id"), F.upper(F.trim("tag")).alias("tag")).where("id <> '' AND tag <> ''")


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """{groups: {group: [child]}} to (group_id, pos, child_id). Text that is no JSON is an error."""
    rows = spark.read.schema("groups map<string,array<string>>").option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("groups").alias("group_id", "children"))
    return rows.select("group_id", F.posexplode("children").alias("pos", "child_id"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a known quality, with the columns of RULE; their order is that of priority and id, which operators.rules goes by. Text that is no JSON is an error."""
    return spark.read.schema(RULE).option("mode", "FAILFAST").json(path).where("quality IN ('approx', 'exact', 'manual')")


def with_provenance(df: DataFrame) -> DataFrame:
    """df as read from files, with the name of each row's file."""
    return df.withColumn("source_member", F.element_at(F.split("_metadata.file_path", "/"), -1))


def build_by_chunks(chunks: DataFrame, builder: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """The products of all chunk files together: builder gets the rows of all chunks with the name of the column that tells their chunk, and
    groups by it, so that chunks are worked on side by side and no product waits for another."""
    return builder(chunks.withColumn("chunk", F.col("_metadata.file_path")), "chunk")


def file_ledger(spark: SparkSession, path: str) -> DataFrame:
    """(name, size, sha256) of each file under path; a task holds one file at a time."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def shard_id(x: Column, width: float = 10.0) -> Column:
    """Longitude shard of a box centre; outside the globe: low_priority."""
    return F.when((x >= -180) & (x < 180), F.concat(F.lit("lon_"), F.floor((x + 180) / width).cast("int"))).otherwise("low_priority")


def write_shards(df: DataFrame, path: str, x: Column, rows_per_file: int = 1_000_000) -> DataFrame:
    """A folder for each shard, files of bounded size; gives the catalog (shard_id, features). A hot shard is dealt over
    several tasks."""
    out = df.withColumn("shard_id", shard_id(x))
    out.hint("rebalance", "shard_id").write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard_id").parquet(path)
    return df.sparkSession.read.parquet(path).groupBy("shard_id").agg(F.count(F.lit(1)).alias("features"))


def write_tiles(df: DataFrame, path: str, xmin: str, ymin: str, xmax: str, ymax: str, lods: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Each feature in every tile that its box touches, 4 x 2 tiles times the level; gives the manifest (lod, tile,
    feature_count and bounds)."""
    each = df.withColumn("lod", F.explode(F.array(*map(F.lit, lods))))
    w, h = 90.0 / F.col("lod"), 90.0 / F.col("lod")
    cell = lambda c, o, s, n: F.least(F.floor((F.col(c) + o) / s), n - 1)
    each = each.withColumn("tx", F.explode(F.sequence(cell(xmin, 180, w, 4 * F.col("lod")), cell(xmax, 180, w, 4 * F.col("lod")))))
    each = each.withColumn("ty", F.explode(F.sequence(cell(ymin, 90, h, 2 * F.col("lod")), cell(ymax, 90, h, 2 * F.col("lod")))))
    tiles = each.withColumn("tile", F.concat_ws("_", "tx", "ty")).drop("tx", "ty")
    tiles.hint("rebalance", "lod", "tile").write.partitionBy("lod", "tile").parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.groupBy(F.col("lod").cast("int").alias("lod"), "tile").agg(F.count(F.lit(1)).alias("feature_count"), F.min(xmin).alias("xmin"), F.min(ymin).alias("ymin"), F.max(xmax).alias("xmax"), F.max(ymax).alias("ymax"))


_GEOMETRY = "id:string,type:string,arcs:string,coordinates:string,properties:map<string,string>"
TOPOLOGY = f"transform struct<scale:array<double>,translate:array<double>>, arcs array<array<array<double>>>, objects map<string,struct<{_GEOMETRY},geometries:array<struct<{_GEOMETRY}>>>>"


@F.pandas_udf(T.ArrayType(T.ArrayType(T.DoubleType())))
def arc_places(arc: pd.Series, scale: pd.Series, shift: pd.Series) -> pd.Series:
    """An arc's points: of a quantised topology the running sums, scaled and shifted; else as they stand."""
    out = []
    for a, k, t in zip(arc, scale, shift, strict=True):
        p = np.array([list(q)[:2] for q in a], float).reshape(-1, 2)
        out.append((p if k is None else p.cumsum(0) * np.asarray(k, float) + np.asarray(t, float)).tolist())
    return pd.Series(out)


def read_topology(spark: SparkSession, path: str, name: str, properties: list[str], lines: bool = False, id_col: str | None = None) -> DataFrame:
    """The geometries of one object of topologies, a file each (indented or not) or, with lines, a line each: the object's own or those of its collection.
    Columns as of read_geojson. Quantised or not; an arc numbered ~k is arc k backwards; arcs that follow one another share their
    joints. Text that is no JSON, an object or an arc that is not there, is an error.

    Arcs and geometries become rows that meet by topology and arc, so no row carries a whole file's arcs.
    """
    rows = spark.read.schema(TOPOLOGY).option("multiLine", not lines).option("mode", "FAILFAST").json(path)
    rows = scratch(rows.withColumn("topology", F.monotonically_increasing_id()), "topologies")
    arcs = rows.select("topology", "transform", F.posexplode("arcs").alias("arc", "points"))
    arcs = arcs.select("topology", "arc", F.transform(arc_places("points", "transform.scale", "transform.translate"), lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))).alias("points"))
    fields = ["id", "type", "arcs", "coordinates", "properties"]
    own = F.array(F.struct(*[F.col(f"o.{c}").alias(c) for c in fields]))
    there = F.when(F.col("o").isNull(), F.raise_error(F.lit(f"a topology has no object {name}")).cast(f"array<struct<{_GEOMETRY}>>"))
    found = rows.select("topology", "transform", F.try_element_at("objects", F.lit(name)).alias("o")).select("topology", "transform", there.otherwise(F.coalesce("o.geometries", own)).alias("g"))
    each = found.select("topology", "transform", F.posexplode("g").alias("geometry", "g"))
    kind = F.col("g.type")
    rings = F.transform(polygon_parts(kind, F.col("g.arcs"), "array<array<int>>"), lambda polygon: F.transform(polygon, lambda ring: F.struct(ring.alias("arcs"), F.lit(False).alias("open"))))
    paths = F.transform(line_lists(kind, F.col("g.arcs"), "int"), lambda line: F.array(F.struct(line.alias("arcs"), F.lit(True).alias("open"))))
    uses = each.select("topology", "geometry", F.posexplode(F.coalesce(rings, paths)).alias("part", "polygon")).select("topology", "geometry", "part", F.posexplode("polygon").alias("ring", "r"))
    uses = uses.select("topology", "geometry", "part", "ring", F.col("r.open").alias("open"), F.size("r.arcs").alias("n"), F.posexplode("r.arcs").alias("place", "k"))
    met = uses.withColumn("arc", F.when(F.col("k") >= 0, F.col("k")).otherwise(-1 - F.col("k"))).join(arcs, ["topology", "arc"], "left")
    points = F.coalesce("points", F.raise_error(F.lit("a topology lacks an arc that it names")).cast(POINTS))
    piece = F.when(F.col("k") >= 0, points).otherwise(F.reverse(points))
    whole = F.col("open") & (F.col("place") == F.col("n") - 1)
    piece = F.when(whole, piece).otherwise(F.slice(piece, 1, F.size(piece) - 1))  # the last point is the next arc's first
    joined = met.groupBy("topology", "geometry", "part", "ring", "open").agg(F.array_sort(F.collect_list(F.struct("place", piece.alias("points")))).alias("p"))
    joined = joined.select("topology", "geometry", "part", "ring", "open", F.flatten("p.points").alias("points"))
    parts = joined.groupBy("topology", "geometry", "part", "open").agg(F.array_sort(F.collect_list(F.struct("ring", "points"))).alias("r")).select("topology", "geometry", "part", "open", F.col("r.points").alias("rings"))
    parts = parts.groupBy("topology", "geometry", "open").agg(F.array_sort(F.collect_list(F.struct("part", "rings"))).alias("p")).select("topology", "geometry", "open", F.col("p.rings").alias("shape"))
    out = each.join(parts, ["topology", "geometry"], "left")
    at = lambda p, i: F.when(F.col("transform").isNull(), p[i]).otherwise(p[i] * F.get("transform.scale", F.lit(i)) + F.get("transform.translate", F.lit(i)))
    places = F.transform(point_list(kind, F.col("g.coordinates")), lambda p: F.struct(at(p, 0).alias("x"), at(p, 1).alias("y")))
    polygons = F.when(~F.col("open"), F.col("shape"))
    named = [F.col("g.id").alias(id_col)] if id_col else []
    return out.select(*named, *[F.try_element_at("g.properties", F.lit(c)).alias(c) for c in properties], kind.alias("geometry_type"), polygons.alias("parts"), F.when(F.col("open"), F.flatten("shape")).alias("lines"), places.alias("points"), F.flatten(polygons).alias("rings"))


def nested_lists(text: Column, key: str) -> Column:
    """The values of a key, at the top or one level below, of JSON text as an array of strings."""
    top = F.get_json_object(text, f"$.{key}")
    below = F.get_json_object(text, f"$.*.{key}")
    return F.array_compact(F.array(top, below))


def read_code_page_csv(spark: SparkSession, path: str, schema: str, encoding: str) -> DataFrame:
    """CSV in a code page of Java's, text trimmed; sets the session's switch that lets Spark use such charsets."""
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    rows = spark.read.schema(schema).option("encoding", encoding).csv(path)
    return rows.select(*[F.trim(c).alias(c) if kind == "string" else F.col(c) for c, kind in rows.dtypes])
