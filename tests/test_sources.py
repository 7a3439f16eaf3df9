"""Readers of geometry on files as others write them."""

import json
import zipfile

import pytest

from pyspark.sql import functions as F

from meridia.sources.files import read_crs, read_geojson, read_hierarchy, read_keyed_map, read_rules, read_topology, read_zipped_geojson, write_geojson

SQUARE = [[0.0, 0.0], [2.0, 0.0], [2.0, 2.0], [0.0, 2.0]]
FAR = [[x + 10, y] for x, y in SQUARE]


def xy(rings):
    return [[[p.x, p.y] for p in r] for r in rings] if rings is not None else None


FEATURES = [
    {"type": "Feature", "properties": {"id": "a"}, "geometry": {"type": "Polygon", "coordinates": [SQUARE]}},
    {"type": "Feature", "properties": {"id": "b", "n": 3}, "geometry": {"type": "MultiPolygon", "coordinates": [[SQUARE], [FAR, SQUARE]]}},
    {"type": "Feature", "properties": {"id": "c"}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}},
    {"type": "Feature", "properties": {"id": None}, "geometry": None},
]
WANT = {("a", None): [[SQUARE]], ("b", "3"): [[SQUARE], [FAR, SQUARE]], ("c", None): None, (None, None): None}


def parts(rows):
    return {(r.id, r.n): None if r.parts is None else [xy(p) for p in r.parts] for r in rows}


def test_geojson_of_all_types(spark, tmp_path):
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(f) for f in FEATURES))
    (tmp_path / "whole.json").write_text(json.dumps({"type": "FeatureCollection", "features": FEATURES}, indent=2))
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.write(tmp_path / "whole.json", "inner/ne_10m.geojson")
        z.writestr("readme.txt", "no")
    got = read_geojson(spark, f"file://{tmp_path}/lines.json", ["id", "n"]).collect()
    assert parts(got) == WANT and xy(got[1].rings) == [SQUARE, FAR, SQUARE]
    assert parts(read_geojson(spark, f"file://{tmp_path}/whole.json", ["id", "n"], collection=True).collect()) == WANT
    assert parts(read_zipped_geojson(spark, f"file://{tmp_path}/x.zip", "*/ne_*.geojson", ["id", "n"]).collect()) == WANT
    with pytest.raises(Exception, match="no member"):
        read_zipped_geojson(spark, f"file://{tmp_path}/x.zip", "*.shp", ["id"]).collect()
    (tmp_path / "bad.json").write_text('{"properties": {')
    with pytest.raises(Exception):
        read_geojson(spark, f"file://{tmp_path}/bad.json", ["id"]).collect()


def test_topology_of_all_kinds(spark, tmp_path):
    # Two squares that share an edge, as three arcs; all rings are closed.
    shared, left, right = [[2, 0], [2, 2]], [[2, 2], [0, 2], [0, 0], [2, 0]], [[2, 2], [4, 2], [4, 0], [2, 0]]
    geometries = [
        {"type": "Polygon", "arcs": [[0, 1]], "properties": {"id": "l"}}, {"type": "Polygon", "arcs": [[0, 2]], "properties": {"id": "r"}}, {"type": "Polygon", "arcs": [[-3, -1]], "properties": {"id": "back"}},
        {"type": "MultiPolygon", "arcs": [[[0, 1]], [[0, 2]]], "properties": {"id": "both"}}, {"type": "Point", "coordinates": [1, 1], "properties": {"id": "p"}},
    ]
    plain = {"type": "Topology", "arcs": [shared, left, right], "objects": {"political": {"type": "GeometryCollection", "geometries": geometries}}}
    steps = lambda a: [[10 * (x - (a[i - 1][0] if i else 0)), 10 * (y - (a[i - 1][1] if i else 0))] for i, (x, y) in enumerate(a)]
    quantised = plain | {"arcs": [steps(a) for a in (shared, left, right)], "transform": {"scale": [0.1, 0.1], "translate": [5, -5]}}
    ring_l, ring_r, back = [[2, 0], [2, 2], [0, 2], [0, 0]], [[2, 0], [2, 2], [4, 2], [4, 0]], [[2, 0], [4, 0], [4, 2], [2, 2]]
    want = {"l": [[ring_l]], "r": [[ring_r]], "back": [[back]], "both": [[ring_l], [ring_r]], "p": None}
    moved = {k: v and [[[[x + 5, y - 5] for x, y in r] for r in p] for p in v] for k, v in want.items()}
    read = lambda **k: {r.id: r.parts and [[[[round(q, 9) for q in p] for p in r] for r in xy(part)] for part in r.parts] for r in read_topology(spark, f"file://{tmp_path}/t", "political", ["id"], **k).collect()}
    (tmp_path / "t").mkdir()
    for indent in (None, 2):
        for topology, found in ((plain, want), (quantised, moved)):
            (tmp_path / "t" / "x.json").write_text(json.dumps(topology, indent=indent))
            assert read() == found
    (tmp_path / "t" / "y.json").write_text(json.dumps(plain).replace('"l"', '"l2"').replace('"r"', '"r2"'))
    assert len(read()) == 7
    (tmp_path / "t" / "x.json").write_text(json.dumps(plain) + "\n" + json.dumps(quantised))
    assert len(read_topology(spark, f"file://{tmp_path}/t", "political", ["id"], lines=True).collect()) == 15
    with pytest.raises(Exception, match="no object nothing"):
        read_topology(spark, f"file://{tmp_path}/t", "nothing", ["id"], lines=True).collect()
    (tmp_path / "t" / "y.json").write_text(json.dumps(plain | {"arcs": [shared]}))
    with pytest.raises(Exception, match="lacks an arc"):
        read(lines=True)
    (tmp_path / "t" / "y.json").write_text('{"arcs": [[')
    with pytest.raises(Exception):
        read(lines=True)


def points(rows):
    return None if rows is None else [(p.x, p.y) for p in rows]


def lines(rows):
    return None if rows is None else [points(r) for r in rows]


def test_points_lines_ids_and_the_coordinate_system(spark, tmp_path):
    shapes = [
        (7, "Point", [1.0, 2.0]), ("p2", "MultiPoint", [[1.0, 2.0], [3.0, 4.0]]), ("l", "LineString", [[0.0, 0.0], [1.0, 1.0]]), ("m", "MultiLineString", [[[0.0, 0.0], [1.0, 1.0]], [[2.0, 2.0], [3.0, 2.0]]]),
        (None, "Polygon", [SQUARE]),
    ]
    features = [{"type": "Feature", **({"id": i} if i is not None else {}), "properties": {}, "geometry": {"type": k, "coordinates": c}} for i, k, c in shapes]
    features.append({"type": "Feature", "id": "gc", "properties": {}, "geometry": {"type": "GeometryCollection", "geometries": []}})
    (tmp_path / "g.json").write_text(json.dumps({"type": "FeatureCollection", "crs": {"type": "name", "properties": {"name": "EPSG:3857"}}, "features": features}))
    got = {r.own: (r.geometry_type, points(r.points), lines(r.lines), r.parts and [xy(p) for p in r.parts]) for r in read_geojson(spark, f"file://{tmp_path}/g.json", [], collection=True, id_col="own").collect()}
    assert got == {
        "7": ("Point", [(1, 2)], None, None), "p2": ("MultiPoint", [(1, 2), (3, 4)], None, None), "l": ("LineString", None, [[(0, 0), (1, 1)]], None), "m": ("MultiLineString", None, [[(0, 0), (1, 1)], [(2, 2), (3, 2)]], None),
        None: ("Polygon", None, None, [[SQUARE]]), "gc": ("GeometryCollection", None, None, None),
    }
    assert [tuple(r) for r in read_crs(spark, f"file://{tmp_path}/g.json").collect()] == [("g.json", "EPSG:3857")]
    (tmp_path / "h.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert read_crs(spark, f"file://{tmp_path}/h.json").first().crs.endswith("CRS84")


def test_written_layers_come_back(spark, tmp_path):
    p = lambda *q: F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in q])
    many = spark.range(3).withColumns({"points": F.when(F.col("id") == 0, p((1, 2))).when(F.col("id") == 1, p((1, 2), (3, 4))), "lines": F.when(F.col("id") == 0, F.array(p((1, 2), (3, 4)))).when(F.col("id") == 1, F.array(p((1, 2), (3, 4)), p((5, 6), (7, 8))))})
    for shape, kinds in (("points", ["Point", "MultiPoint", None]), ("lines", ["LineString", "MultiLineString", None])):
        write_geojson(many, f"file://{tmp_path}/{shape}", shape, ["id"], id_col="id")
        back = {r.own: r for r in read_geojson(spark, f"file://{tmp_path}/{shape}", ["id"], id_col="own").collect()}
        assert [back[str(k)].geometry_type for k in range(3)] == kinds and all(r.id == k for k, r in back.items())
        assert {r.own: r[shape] for r in back.values()} == {str(r.id): r[shape] for r in many.collect()}


def test_topology_of_points_lines_and_single_objects(spark, tmp_path):
    arcs = [[[0, 0], [1, 0]], [[1, 0], [2, 0], [2, 1]], [[5, 5], [6, 6]], [[0, 0], [0, 2], [2, 2], [0, 0]]]
    geometries = [{"type": "LineString", "id": "road", "arcs": [0, 1]}, {"type": "LineString", "id": "back", "arcs": [-2, -1]}, {"type": "MultiLineString", "id": 3, "arcs": [[0, 1], [2]]}, {"type": "MultiPoint", "id": "mp", "coordinates": [[1, 1], [2, 3]]}, {"type": "Polygon", "id": "t", "arcs": [[3]]}]
    top = {"type": "Topology", "arcs": arcs, "objects": {"all": {"type": "GeometryCollection", "geometries": geometries}, "one": {"type": "Polygon", "id": "solo", "properties": {"n": "x"}, "arcs": [[3]]}, "dot": {"type": "Point", "coordinates": [4, 5]}, "none": {"type": "GeometryCollection", "geometries": []}}}
    (tmp_path / "t.json").write_text(json.dumps(top))
    read = lambda name: {r.own: r for r in read_topology(spark, f"file://{tmp_path}/t.json", name, ["n"], id_col="own").collect()}
    got = read("all")
    assert {k: lines(r.lines) for k, r in got.items()} == {"road": [[(0, 0), (1, 0), (2, 0), (2, 1)]], "back": [[(2, 1), (2, 0), (1, 0), (0, 0)]], "3": [[(0, 0), (1, 0), (2, 0), (2, 1)], [(5, 5), (6, 6)]], "mp": None, "t": None}
    assert points(got["mp"].points) == [(1, 1), (2, 3)] and xy(got["t"].rings) == [[[0, 0], [0, 2], [2, 2]]] and got["road"].parts is None
    assert [(k, r.n, xy(r.rings)) for k, r in read("one").items()] == [("solo", "x", [[[0, 0], [0, 2], [2, 2]]])]
    assert points(read("dot")[None].points) == [(4, 5)] and read("none") == {}
    (tmp_path / "t.json").write_text(json.dumps(top | {"transform": {"scale": [0.5, 2], "translate": [10, 20]}, "arcs": [[[0, 0], [2, 1]]] * 4}))
    assert points(read("dot")[None].points) == [(12, 30)] and lines(read("all")["road"].lines) == [[(10, 20), (10, 20), (11, 22)]]


def test_broken_files_are_errors(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"owners": {"a": "x", "b"')
    (tmp_path / "h.json").write_text('{"groups": {"a": ["x"')
    (tmp_path / "r.json").write_text('{"rule_id": "a", "quality": "exact", "incl')
    for read in (lambda: read_keyed_map(spark, f"file://{tmp_path}/m.json", "owners"), lambda: read_hierarchy(spark, f"file://{tmp_path}/h.json"), lambda: read_rules(spark, f"file://{tmp_path}/r.json")):
        with pytest.raises(Exception, match="(?i)malformed"):
            read().collect()
