"""Selections, ranks, graphs and rules against plain loops."""

import math
import random
from collections import defaultdict

from pyspark.sql import functions as F

from meridia.operators import graph, rules, selection
from meridia.plans import QUERIES
from meridia.plans.more import PALETTE
from meridia.sources.views import Layers


def greedy(rows, budget, most, least):
    used, ids = 0, []
    for *_, i, cost in sorted(rows):
        if len(ids) < most and (len(ids) < least or used + cost <= budget):
            used, ids = used + cost, [*ids, i]
    return used, ids


def test_budget_by_a_plain_loop(spark):
    rng = random.Random(7)
    rows = [(g, round(rng.random(), 2), i, rng.choice([0, 1, 2, 5, 9, 30])) for g in range(12) for i in range(rng.randint(0, 80))]
    df = spark.createDataFrame(rows, "g long, o double, id long, cost long")
    for budget, most, least in ((20, 1000, 0), (20, 6, 3), (3, 1000, 5), (0, 4, 2), (100, 3, 9)):
        got = defaultdict(lambda: (0, []))
        for r in selection.within_budget(df, "g", [F.col("o")], "id", F.col("cost"), budget, most, least).orderBy("g", "pos").collect():
            got[r.g] = r.used, [*got[r.g][1], r.id]
        for g in range(12):
            assert got[g] == greedy([(o, i, c) for h, o, i, c in rows if h == g], budget, most, least), (budget, most, least)


def overlap(a, b):
    return max(0.0, min(a.xmax, b.xmax) - max(a.xmin, b.xmin)) * max(0.0, min(a.ymax, b.ymax) - max(a.ymin, b.ymin))


def test_chunk_queries_by_a_plain_loop(spark, sf):
    v = Layers(spark, sf)
    zones, units = v.zones.collect(), v.units.collect()
    plain = {r.view: (r.used, r.ids) for r in QUERIES["e8_budget_selection"](spark, sf).collect()}
    focused = defaultdict(lambda: (0, []))
    for r in QUERIES["e8_focused_selection"](spark, sf).orderBy("view", "pos").collect():
        focused[r.view] = r.used, [*focused[r.view][1], r.id]
    for u in units:
        own = [(z, overlap(z, u)) for z in zones if overlap(z, u) > 0]
        assert plain.get(u.unit_id, (0, [])) == greedy([(-s, z.zone_id, z.zone_id % 7 + 1) for z, s in own], 20, 1 << 20, 0)
        far = lambda z: round(math.hypot((z.xmin + z.xmax - u.xmin - u.xmax) / 2, (z.ymin + z.ymax - u.ymin - u.ymax) / 2), 4)
        share = lambda z, s: -round(s / max((z.xmax - z.xmin) * (z.ymax - z.ymin), 1.0), 4)
        rows = [(z.zone_id % 25 != u.unit_id, z.zone_id % 3 != 0, share(z, s), far(z), z.zone_id, z.zone_id % 7 + 1) for z, s in own]
        assert focused[u.unit_id] == greedy(rows, 20, 8, 3)


def test_ranks_and_numbers(spark):
    rng = random.Random(3)
    values = [rng.choice([1.5, 2.0, rng.random() * 100]) for _ in range(500)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "id long, x double").repartition(7)
    row = selection.at_ranks(df, "x", {"a": 0.0, "b": 0.5, "c": 0.993, "d": 1.0}).first()
    ordered = sorted(values)
    assert (row.n, row.top) == (500, ordered[-1]) and [row.a, row.b, row.c, row.d] == [ordered[int(499 * q + 0.5)] for q in (0.0, 0.5, 0.993, 1.0)]
    assert selection.at_ranks(df.limit(0), "x", {"a": 0.5}).first().a is None
    got = sorted((r.number, r.x, r.id) for r in selection.numbered(df, [F.col("x"), F.col("id")]).collect())
    assert got == [(k, x, i) for k, (x, i) in enumerate(sorted((x, i) for i, x in enumerate(values)))]


def test_components_by_union_find(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(120)] + [(400, 400)]
    root = {i: i for i in range(450)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    nodes = spark.range(450).select("id")
    got = {r.id: r.component for r in graph.components(nodes, spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: find(i) for i in range(450)}


def lab(c):
    lin = [x / 12.92 if x <= 0.04045 else ((x + 0.055) / 1.055) ** 2.4 for x in (int(c[i : i + 2], 16) / 255 for i in (1, 3, 5))]
    f = []
    for w, row in zip((0.95047, 1.0, 1.08883), ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041)), strict=True):
        t = sum(a * b for a, b in zip(lin, row, strict=True)) / w
        f.append(t ** (1 / 3) if t > 0.008856 else 7.787 * t + 16 / 116)
    return 116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])


def test_palette_one_by_one(spark):
    rng = random.Random(2)
    edges = {tuple(sorted(rng.sample(range(40), 2))) for _ in range(120)} | {(k, 50) for k in range(20)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    fixed = {3: "#3cb44b", 9: "#123456"}
    done = {k: c.upper() for k, c in fixed.items()}
    for i in sorted((i for i in range(52) if i not in fixed), key=lambda i: (-len(near[i]), i)):
        used = {done[j] for j in near[i] if j in done}
        score = lambda k: (PALETTE[k].upper() not in used, min((round(math.dist(lab(PALETTE[k].upper()), lab(u)), 6) for u in used), default=math.inf), -k)
        done[i] = PALETTE[max(range(len(PALETTE)), key=score)].upper()
    nodes = spark.createDataFrame([(i, fixed.get(i)) for i in range(52)], "id long, fixed string")
    got = graph.palette_colours(nodes, spark.createDataFrame(list(edges), "src long, dst long"), spark.createDataFrame(list(enumerate(PALETTE)), "place int, colour string"))
    assert {r.id: r.colour for r in got.collect()} == done


def plain_simplify(line, tolerance):
    """Douglas and Peucker by recursion."""
    if len(line) < 3:
        return line
    (ax, ay), (bx, by) = line[0], line[-1]
    n = math.hypot(bx - ax, by - ay)
    far = [abs((bx - ax) * (y - ay) - (by - ay) * (x - ax)) / n if n else math.hypot(x - ax, y - ay) for x, y in line[1:-1]]
    k = max(range(len(far)), key=lambda i: far[i])
    return plain_simplify(line[: k + 2], tolerance)[:-1] + plain_simplify(line[k + 1 :], tolerance) if far[k] > tolerance else [line[0], line[-1]]


def test_simplified_lines(spark, sf):
    items = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect():
        items[r.l_orderkey].append((r.l_linenumber, r.l_quantity, r.l_partkey, r.l_suppkey))
    length = lambda p: sum(math.dist(a, b) for a, b in zip(p, p[1:]))
    for r in QUERIES["h22_simplify"](spark, sf).collect():
        line = sorted((float(n), float(q)) for n, q, *_ in items[r.l_orderkey])
        want = plain_simplify(line, 5.0)
        assert (r.before, r.after) == (len(line), len(want)) and abs(r.length - length(want)) < 1e-5
    for r in QUERIES["h22_simplify_metres"](spark, sf).collect():
        line = [(x, y) for _, x, y in sorted((n, (p * 7919 % 3600) / 100.0 - 18, (s * 104729 % 1400) / 100.0 + 40) for n, _, p, s in items[r.l_orderkey])]
        metre = math.pi / 180 * 6_371_008.8
        flat = math.cos(math.radians(sum(y for _, y in line) / len(line)))
        back = {(x * metre * flat, y * metre): f"{round(x, 4)} {round(y, 4)}" for x, y in line}
        assert r.kept == [back[p] for p in plain_simplify([(x * metre * flat, y * metre) for x, y in line], 50_000.0)]
    line = [(0.0, 60.0), (0.5, 60.2), (1.0, 60.0)]  # the bend is 22 km off the chord, in degrees it would be 0.2
    df = spark.createDataFrame([([{"x": x, "y": y} for x, y in line],)], "line array<struct<x:double,y:double>>")
    from meridia.functions.geometry import simplify

    assert [len(df.select(simplify(t, degrees=True)("line").alias("s")).first().s) for t in (22_000.0, 23_000.0)] == [3, 2]


def test_rule_order_and_errors(spark):
    features = spark.createDataFrame([(i, "AB"[i % 2], "AB"[i % 2]) for i in range(10)], "id long, owner string, controller string")
    table = spark.createDataFrame([("r1", 1, "X", ["A"], [], ["2"]), ("r2", 1, "Y", [], ["4", "99"], []), ("r3", 9, "Z", ["C"], [], []), ("r0", 5, "W", [], ["6"], [])], "rule_id string, priority int, tag string, c array<string>, i array<string>, x array<string>")
    chosen = rules.selectors(table.withColumn("none", F.array().cast("array<string>")), {"country": ("c", "none"), "id": ("i", "x")})
    known = rules.members(features, "id", {"country": F.col("owner"), "id": F.col("id")})
    hit = rules.targets(chosen, known)
    applied = {r.id: (r.owner, r.controller, r.core) for r in rules.apply_pack(features, "id", table, hit).collect()}
    assert applied == {i: (t := {0: "X", 4: "Y", 6: "W", 8: "X"}.get(i, "AB"[i % 2]), t, t) for i in range(10)}
    assert {(r.rule_id, r.value) for r in rules.missing(chosen, known).collect()} == {("r2", "99"), ("r3", "C")}
    retired = spark.createDataFrame([("A",), ("Q",)], "tag string")
    errors = {tuple(r) for r in rules.pack_errors(table, hit, rules.apply_pack(features, "id", table, hit), retired).collect()}
    assert errors == {("no target", "r3", 0), ("retired owner", "A", 1)}
