"""Queries of back-fills, votes, names and clusters (2.D, 2.E, 2.G, 2.I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from meridia.functions import scalars as S
from meridia.operators import ownership as O
from meridia.operators import spatial as G

from .joins import _IN, _MEET, BOX, BOX2, second
from .registry import query
from .scalars import _HAV, _LIN


@query("g17_backfill_reasons", "WITH f AS (SELECT feature_id, owner AS candidate, controller, CASE WHEN feature_id % 4 <> 0 THEN owner END AS given FROM features) SELECT feature_id, CASE WHEN given IS NOT NULL THEN given WHEN controller = candidate AND feature_id % 8 <> 0 THEN candidate END AS owner, CASE WHEN given IS NOT NULL THEN 'given' WHEN controller <> candidate THEN 'controller' WHEN feature_id % 8 = 0 THEN 'core' ELSE 'filled' END AS reason FROM f")
def _(v):
    # Every fourth owner is blank; every eighth feature is no core of its candidate.
    f = v.features.select("feature_id", F.when(F.col("feature_id") % 4 != 0, F.col("owner")).alias("owner"), F.col("owner").alias("candidate"), "controller")
    cores = v.features.where("feature_id % 8 <> 0").select("feature_id", F.col("owner").alias("tag"))
    return O.consistent_backfill(f, "feature_id", "owner", "candidate", "controller", cores, "tag").select("feature_id", "owner", "reason")


@query(
    "i5_vote_steps",
    f"""WITH u AS (SELECT *, CASE WHEN unit_id % 3 <> 0 THEN unit_id * unit_id % 4 END AS value, unit_id % 4 AS country FROM units),
n AS (SELECT a.unit_id, b.value, count(*) AS k FROM u a JOIN u b ON a.unit_id <> b.unit_id AND b.value IS NOT NULL AND {_MEET.format('a', 'b')} GROUP BY 1, 2), nt AS (SELECT unit_id, max(k) AS k FROM n GROUP BY 1), nv AS (SELECT unit_id, min(value) AS value FROM n JOIN nt USING (unit_id, k) GROUP BY unit_id HAVING count(*) = 1),
c AS (SELECT country, value, count(*) AS k FROM u WHERE value IS NOT NULL GROUP BY 1, 2), ct AS (SELECT country, max(k) AS k FROM c GROUP BY 1), cv AS (SELECT country, min(value) AS value FROM c JOIN ct USING (country, k) GROUP BY country HAVING count(*) = 1)
SELECT u.unit_id, coalesce(u.value, nv.value, cv.value, -u.group_id) AS value, CASE WHEN u.value IS NOT NULL THEN 'own' WHEN nv.value IS NOT NULL THEN 'neighbours' WHEN cv.value IS NOT NULL THEN 'country' ELSE 'owner' END AS step FROM u LEFT JOIN nv USING (unit_id) LEFT JOIN cv USING (country)""",
)
def _(v):
    k = F.col("unit_id")
    u = v.units.select("unit_id", F.when(k % 3 != 0, k * k % 4).alias("value"), (k % 4).alias("country"), (-F.col("group_id")).alias("owner"))
    near = G.box_pairs(v.units.select("unit_id", *BOX), second(v.units, unit_id="other"), BOX, BOX2).where("unit_id <> other").select("unit_id", "other")
    return O.voted(u, "unit_id", "value", "country", "owner", near)


@query(
    "e14_best_names",
    f"WITH p AS (SELECT u.unit_id, p.name, row_number() OVER (PARTITION BY u.unit_id ORDER BY p.population DESC, p.place_id) AS rn FROM places p JOIN units u ON {_IN} WHERE p.population >= 9000000 AND u.unit_id % 3 <> 0), f AS (SELECT unit_id, name, row_number() OVER (PARTITION BY unit_id ORDER BY feature_id) AS rn FROM features WHERE unit_id % 5 <> 0) SELECT u.unit_id, coalesce(p.name, f.name, u.name) AS name, CASE WHEN p.name IS NOT NULL THEN 'place' WHEN f.name IS NOT NULL THEN 'member' ELSE 'own' END AS step FROM units u LEFT JOIN p ON p.unit_id = u.unit_id AND p.rn = 1 LEFT JOIN f ON f.unit_id = u.unit_id AND f.rn = 1",
)
def _(v):
    # Some units have no great place, and some of these no member either: places of every third and members of every fifth unit are left out.
    u = v.units.select("unit_id", "name", G.box_rings(*BOX).alias("rings"))
    great = G.within(v.places.where("population >= 9000000").select("place_id", F.col("name").alias("pname"), "population", "lon", "lat"), u.select("unit_id", "rings"), "rings", key="unit_id").where("unit_id % 3 <> 0")
    great = great.select(F.col("pname").alias("name"), "place_id", "population", "lon", "lat")
    members = v.features.where("unit_id % 5 <> 0").select("unit_id", "name", "feature_id")
    return O.best_names(u, "unit_id", "name", "rings", great, [F.col("population"), -F.col("place_id")], members, [-F.col("feature_id")])


_KM = _HAV.format(a="a.lat", b="b.lat", c="a.lon", d="b.lon")


@query("i8_cluster_donors", f"WITH RECURSIVE e AS (SELECT a.place_id AS x, b.place_id AS y FROM places a JOIN places b ON a.home_unit_id = b.home_unit_id AND a.place_id <> b.place_id WHERE {_KM} <= 400), r AS (SELECT place_id, place_id AS seen FROM places UNION SELECT r.place_id, e.y FROM r JOIN e ON e.x = r.seen), c AS (SELECT place_id, min(seen) AS cluster FROM r GROUP BY place_id) SELECT cluster, p.home_unit_id, count(*) AS members, list_sort(list(DISTINCT p.kind)) AS donors FROM c JOIN places p USING (place_id) GROUP BY cluster, p.home_unit_id", lists=("donors",))
def _(v):
    return O.near_clusters(v.places, "place_id", "home_unit_id", "kind", 400)


@query(
    "d23_contrast_threshold",
    f"""WITH c AS (SELECT unit_id AS id, (unit_id * 37) % 4 * 60 AS r, (unit_id * 101) % 3 * 90 AS g, (unit_id * 211) % 2 * 120 AS b FROM units),
l AS (SELECT id, r * 65536 + g * 256 + b AS code, {_LIN.format('r')} AS r, {_LIN.format('g')} AS g, {_LIN.format('b')} AS b FROM c),
t AS (SELECT id, code, (r * 0.4124564 + g * 0.3575761 + b * 0.1804375) / 0.95047 AS x, r * 0.2126729 + g * 0.7151522 + b * 0.0721750 AS y, (r * 0.0193339 + g * 0.1191920 + b * 0.9503041) / 1.08883 AS z FROM l),
f AS (SELECT id, code, CASE WHEN x > 0.008856 THEN cbrt(x) ELSE 7.787 * x + 16.0 / 116 END AS x, CASE WHEN y > 0.008856 THEN cbrt(y) ELSE 7.787 * y + 16.0 / 116 END AS y, CASE WHEN z > 0.008856 THEN cbrt(z) ELSE 7.787 * z + 16.0 / 116 END AS z FROM t),
p AS (SELECT a.unit_id AS src, b.unit_id AS dst FROM units a JOIN units b ON a.unit_id < b.unit_id AND {_MEET.format('a', 'b')})
SELECT count(*) AS edges, count(*) FILTER (WHERE m.code = n.code) AS same, count(*) FILTER (WHERE sqrt(pow(116 * (m.y - n.y), 2) + pow(500 * (m.x - m.y - n.x + n.y), 2) + pow(200 * (m.y - m.z - n.y + n.z), 2)) < 40) AS low FROM p JOIN f m ON m.id = p.src JOIN f n ON n.id = p.dst""",
)
def _(v):
    k = F.col("unit_id")
    hexes = F.concat(F.lit("#"), *[F.lpad(F.hex((k * m) % n * w), 2, "0") for m, n, w in ((37, 4, 60), (101, 3, 90), (211, 2, 120))])
    pairs = G.box_pairs(v.units.withColumnRenamed("unit_id", "src"), second(v.units, unit_id="dst"), BOX, BOX2).where("src < dst")
    return O.contrast(pairs.select("src", "dst"), v.units.select(k.alias("id"), hexes.alias("colour")), S.delta_e, 40.0)
