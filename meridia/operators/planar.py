"""Planar maps as tables of edges: noding, outlines, rings, polygons and lines.

An edge is a row (x0, y0, x1, y1) with the inside on its left. Edges are split where others touch or cross them, those that
two members of a group share cancel out, and each edge that is left is followed by the next one at its end. Pointer doubling
along these links names every ring or line and orders its edges: a written table a round, rounds by the logarithm
of the longest. No job holds more of a map in one row than one ring or line, where that is the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from meridia.functions import geometry as M
from meridia.sources.shared import discard, scratch

from . import spatial as G
from .selection import following

ENDS = ["x0", "y0", "x1", "y1"]
#: How far off a segment a point may lie that counts as on it, in units of the coordinates (degrees: a tenth of a millimetre).
TOUCH = 1e-9


def directed(polygons: DataFrame, rings: str) -> DataFrame:
    """The polygons' edges with their other columns, the inside on the left whichever way the rings are wound: the first ring is the outer one,
    others are holes. Closed rings may repeat their first point; edges without length are none."""
    wound = F.transform(F.col(rings), lambda r, k: F.when(k == 0, M.rewind(r)).otherwise(F.reverse(M.rewind(r))))
    each = polygons.withColumn("_ring", F.explode(wound)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("_ring") - 1)))
    a, b = F.get("_ring", F.col("_i")), F.get("_ring", (F.col("_i") + 1) % F.size("_ring"))
    out = each.select(*[c for c in polygons.columns if c != rings], a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))
    return out.where("x0 <> x1 OR y0 <> y1")


def _low_high() -> tuple[Column, Column]:
    a, b = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"))
    return F.least(a, b), F.greatest(a, b)


def segments(edges: DataFrame, scope: list[str]) -> DataFrame:
    """The different segments of a scope, each once, the lesser end first."""
    low, high = _low_high()
    return edges.select(*scope, low["x"].alias("x0"), low["y"].alias("y0"), high["x"].alias("x1"), high["y"].alias("y1")).distinct()


def contacts(edges: DataFrame, scope: list[str] | None = None, touch: float = TOUCH) -> DataFrame:
    """(scope, x0, y0, x1, y1, x, y): points strictly inside a segment where another one of its scope (equal columns) ends or crosses it. Empty if
    and only if the edges are noded. Segments meet by cells, equal ones as one."""
    scope = scope or []
    s = scratch(segments(edges, scope).withColumn("_seg", F.monotonically_increasing_id()), "segments")
    box = lambda e, n: [F.least(e[0], e[2]) - touch, F.least(e[1], e[3]) - touch, F.greatest(e[0], e[2]) + touch, F.greatest(e[1], e[3]) + touch]
    other = ["u0", "v0", "u1", "v1"]
    names = [["_ax", "_ay", "_bx", "_by"], ["_cx0", "_cy0", "_dx", "_dy"]]
    left = s.withColumns(dict(zip(names[0], box(ENDS, 0), strict=True)))
    right = s.select(*[F.col(c).alias(f"_s_{c}") for c in scope], F.col("_seg").alias("_seg2"), *[F.col(a).alias(b) for a, b in zip(ENDS, other, strict=True)], *[c.alias(n) for c, n in zip(box(ENDS, 1), names[1], strict=True)])
    pairs = G.box_pairs(left, right, tuple(names[0]), tuple(names[1]), [(c, f"_s_{c}") for c in scope]).where("_seg < _seg2")
    ax, ay, bx, by, cx, cy, dx, dy = map(F.col, ENDS + other)
    orient = lambda px, py, qx, qy, rx, ry: (qx - px) * (ry - py) - (qy - py) * (rx - px)

    def on(px, py, qx, qy, rx, ry) -> Column:
        """r lies on the segment from p to q, off its ends."""
        n, dot = F.hypot(qx - px, qy - py), (rx - px) * (qx - px) + (ry - py) * (qy - py)
        return (F.abs(orient(px, py, qx, qy, rx, ry)) <= touch * n) & (dot > 0) & (dot < n * n) & (F.hypot(rx - px, ry - py) > touch) & (F.hypot(rx - qx, ry - qy) > touch)

    hits = [(ENDS, on(ax, ay, bx, by, cx, cy), cx, cy), (ENDS, on(ax, ay, bx, by, dx, dy), dx, dy), (other, on(cx, cy, dx, dy, ax, ay), ax, ay), (other, on(cx, cy, dx, dy, bx, by), bx, by)]
    same = lambda px, py, qx, qy: F.hypot(px - qx, py - qy) <= touch
    ends_meet = same(ax, ay, cx, cy) | same(ax, ay, dx, dy) | same(bx, by, cx, cy) | same(bx, by, dx, dy)
    da, db = orient(cx, cy, dx, dy, ax, ay), orient(cx, cy, dx, dy, bx, by)
    crosses = ~(hits[0][1] | hits[1][1] | hits[2][1] | hits[3][1] | ends_meet) & (da * db < 0) & (orient(ax, ay, bx, by, cx, cy) * orient(ax, ay, bx, by, dx, dy) < 0)
    at = da / (da - db)  # one point for both segments
    hits += [(e, crosses, ax + (bx - ax) * at, ay + (by - ay) * at) for e in (ENDS, other)]
    cut = [F.when(when, F.struct(*[F.col(c).alias(n) for c, n in zip(e, ENDS, strict=True)], x.alias("x"), y.alias("y"))) for e, when, x, y in hits]
    return pairs.select(*scope, F.explode(F.array_compact(F.array(*cut))).alias("c")).select(*scope, "c.*").distinct()


def noded(edges: DataFrame, scope: list[str] | None = None, touch: float = TOUCH) -> DataFrame:
    """edges split where another edge of their scope ends on them or crosses them, in their own direction and with all their columns. A part takes
    the touching edge's own point, so parts that lie on each other are equal. Cut places are sorted by ranges, however many one edge has."""
    scope = scope or []
    cuts = scratch(contacts(edges, scope, touch), "cuts")
    share = ((F.col("x") - F.col("x0")) * (F.col("x1") - F.col("x0")) + (F.col("y") - F.col("y0")) * (F.col("y1") - F.col("y0"))) / (F.pow(F.col("x1") - F.col("x0"), 2) + F.pow(F.col("y1") - F.col("y0"), 2))
    ends = cuts.select(*scope, *ENDS).distinct().select(*scope, *ENDS, F.explode(F.array(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y"), F.lit(0.0).alias("t")), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(1.0).alias("t")))).alias("p")).select(*scope, *ENDS, "p.*")
    stops = cuts.select(*scope, *ENDS, "x", "y", share.alias("t")).unionByName(ends)
    parts = following(stops, [*scope, *ENDS], ["t", "x", "y"], ["x", "y"]).where("next IS NOT NULL AND (x <> next.x OR y <> next.y)")
    low, high = _low_high()
    parts = parts.select(*[F.col(c).alias(f"_s_{c}") for c in scope], F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")).alias("_low2"), F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("_high2"), F.struct("x", "y").alias("_p"), F.col("next").alias("_q"))
    keyed = edges.withColumns({"_low": low, "_high": high})
    on = [F.col(c).eqNullSafe(F.col(f"_s_{c}")) for c in scope] + [F.col("_low") == F.col("_low2"), F.col("_high") == F.col("_high2")]
    both = keyed.join(parts, on, "left")
    along = F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")) == F.col("_low")
    first, last = F.when(along, F.col("_p")).otherwise(F.col("_q")), F.when(along, F.col("_q")).otherwise(F.col("_p"))
    new = {"x0": F.coalesce(first["x"], "x0"), "y0": F.coalesce(first["y"], "y0"), "x1": F.coalesce(last["x"], "x1"), "y1": F.coalesce(last["y"], "y1")}
    return both.select(*[new[c].alias(c) if c in new else c for c in edges.columns])


def outline(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x0, y0, x1, y1): the edges of each group that no other member has the other way round, in their direction. Edges must be noded
    (noded, contacts). An edge that a group has twice the same way is an error, as members overlap there."""
    low, high = _low_high()
    way = F.when(F.struct(F.col("x0").alias("x"), F.col("y0").alias("y")) == low, 1).otherwise(-1)
    net = edges.groupBy(*keys, low.alias("_a"), high.alias("_b")).agg(F.sum(way).alias("_n")).where("_n <> 0")
    net = net.withColumn("_n", F.when(F.abs("_n") > 1, F.raise_error(F.lit("two members of a group have an edge on the same side: they overlap")).cast("long")).otherwise(F.col("_n")))
    end = lambda one, two, c: F.when(F.col("_n") > 0, F.col(f"{one}.{c}")).otherwise(F.col(f"{two}.{c}"))
    return net.select(*keys, end("_a", "_b", "x").alias("x0"), end("_a", "_b", "y").alias("y0"), end("_b", "_a", "x").alias("x1"), end("_b", "_a", "y").alias("y1"))


def ranked(links: DataFrame) -> DataFrame:
    """List ranking of links (id, next, label): (id, chain, place, closed). Each id follows at most one other, and next is null at the end of an open
    chain. Rising place is the order along the chain, which a closed one begins at its least label; labels are unique. chain is the id of an open
    chain's last member, of a closed one's first.

    In a round every member learns of twice as many that follow: the least label among them and how far it is, and the member furthest on. It
    ends when a round brings no lesser label and no further end.
    """
    start = links.select("id", "next", F.struct("label", "id").alias("best"), F.lit(0).cast("long").alias("off"), F.coalesce("next", "id").alias("at"), F.when(F.col("next").isNotNull(), 1).otherwise(0).cast("long").alias("hops"))
    span, now = 1, scratch(start, "ranks-0")
    was = None
    while True:
        b = now.select(F.col("id").alias("next"), F.col("next").alias("n2"), F.col("best").alias("b2"), F.col("off").alias("o2"), F.col("at").alias("a2"), F.col("hops").alias("h2"))
        lesser = F.col("b2") < F.col("best")
        moved = now.where("next IS NOT NULL").join(b, "next").select(
            "id", F.col("n2").alias("next"), F.least("best", "b2").alias("best"), F.when(lesser, F.col("o2") + span).otherwise(F.col("off")).alias("off"), F.col("a2").alias("at"), (F.col("hops") + F.col("h2")).alias("hops"), lesser.alias("lesser"))
        # Members that know their end stay as they are.
        seen = Observation()
        both = moved.unionByName(now.where("next IS NULL").withColumn("lesser", F.lit(False))).observe(seen, F.count_if("lesser").alias("lesser"), F.count_if(F.col("next").isNull()).alias("ended"))
        new = scratch(both.drop("lesser"), "ranks")
        discard(now)
        now, span, state = new, span * 2, seen.get
        if not state["lesser"] and state["ended"] == was:
            break
        was = state["ended"]
    closed = F.col("next").isNotNull()
    first = F.when(F.col("off") == 0, F.lit(-(1 << 62))).otherwise(-F.col("off"))
    return now.select("id", F.when(closed, F.col("best.id")).otherwise(F.col("at")).alias("chain"), F.when(closed, first).otherwise(-F.col("hops")).alias("place"), closed.alias("closed"))


def _keys(keys: list[str]) -> Column:
    """The keys as one column _k, whatever their names and types."""
    return F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], F.lit(0).alias("none")).alias("_k")


def _named(keys: list[str]) -> list[Column]:
    return [F.col(f"_k.k{i}").alias(k) for i, k in enumerate(keys)]


def rings(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, ring, points, area, corners): the closed rings of an outline, the inside on their left, so that outer rings have positive areas and holes
    negative ones. A ring begins at its least point. Where several meet at a point each keeps to its inside: parts that touch at a corner are two
    rings; a hole that touches its outer ring at a corner is one ring with it. An edge that none follows is an error."""
    h = scratch(edges.select(_keys(keys), *ENDS).withColumn("id", F.monotonically_increasing_id()), "half-edges")
    node = ["_k", "vx", "vy"]
    outs = h.select("_k", F.col("x0").alias("vx"), F.col("y0").alias("vy"), F.col("id").alias("to"), F.atan2(F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")).alias("angle"))
    ins = h.select("_k", F.col("x1").alias("vx"), F.col("y1").alias("vy"), "id", F.atan2(F.col("y0") - F.col("y1"), F.col("x0") - F.col("x1")).alias("angle"))
    degree = scratch(outs.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.min("to").alias("to")), "vertices")
    at = [F.col("i._k").eqNullSafe(F.col("d._k")), F.col("i.vx") == F.col("d.vx"), F.col("i.vy") == F.col("d.vy")]
    one = ins.alias("i").join(degree.alias("d"), at, "left").select("i.id", F.coalesce("d.n", F.lit(0)).alias("n"), F.col("d.to").alias("next"))
    single = one.where("n = 1").select("id", "next").unionByName(one.where("n = 0").select("id", F.raise_error(F.lit("an outline is open: its edges are not noded")).cast("long").alias("next")))
    # Several rings at a vertex: round it clockwise, an edge that comes in is followed by the first that goes out.
    busy = degree.where("n > 1").select(*node)
    around = ins.select(*node, (-F.col("angle")).alias("turn"), F.lit(0).alias("out"), "id").unionByName(outs.select(*node, (-F.col("angle")).alias("turn"), F.lit(1).alias("out"), F.col("to").alias("id")))
    around = scratch(around.alias("i").join(busy.alias("d"), at, "left_semi"), "busy-vertices")
    first = around.groupBy(*node).agg(F.min(F.struct("turn", "out", "id")).alias("first"))
    turned = following(around, node, ["turn", "out", "id"], ["out", "id"]).where("out = 0")
    turned = turned.alias("i").join(first.alias("d"), at).select("i.id", F.coalesce("i.next", F.struct(F.col("d.first.out").alias("out"), F.col("d.first.id").alias("id"))).alias("n"))
    several = turned.select("id", F.when(F.col("n.out") == 1, F.col("n.id")).otherwise(F.raise_error(F.lit("edges overlap at a vertex: the outline is not noded")).cast("long")).alias("next"))
    links = single.unionByName(several).join(h.select("id", F.struct(*ENDS).alias("label")), "id")
    cross = (F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    point = F.struct("place", F.col("x0").alias("x"), F.col("y0").alias("y"))
    found = h.join(ranked(links), "id").groupBy("_k", F.col("chain").alias("ring")).agg(F.array_sort(F.collect_list(point)).alias("p"), F.sum(cross).alias("area"), F.count(F.lit(1)).alias("corners"))
    return found.select(*_named(keys), "ring", F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))).alias("points"), "area", "corners")


def nested(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, part, rings, area, holes): polygons of rings' result: every hole is with the least outer ring of its keys that holds a point inside it."""
    found = scratch(found.select(_keys(keys), "ring", "points", "area"), "rings")
    outer = found.where("area > 0")
    inner = found.where("area <= 0").withColumn("c", M.inner_point(F.array("points")))
    inner = inner.select(F.col("_k").alias("hole_k"), F.col("ring").alias("hole"), F.col("points").alias("hole_points"), F.col("area").alias("hole_area"), F.col("c.x").alias("lon"), F.col("c.y").alias("lat"))
    shells = outer.select(F.col("_k").alias("shell_k"), F.col("ring").alias("part"), F.col("area").alias("shell_area"), F.array("points").alias("shell"))
    held = G.within(inner.select("hole", "hole_k", "hole_area", "lon", "lat"), shells, "shell", key="part")
    # Islands in a hole have less area than it, the rings around it have more.
    held = held.where(F.col("hole_k").eqNullSafe(F.col("shell_k")) & (F.col("shell_area") > -F.col("hole_area")))
    owner = held.groupBy("hole").agg(F.min(F.struct("shell_area", "part"))["part"].alias("ring"))
    holes = inner.join(owner, "hole").groupBy("ring").agg(F.array_sort(F.collect_list("hole_points")).alias("holes"), F.sum("hole_area").alias("less"))
    whole = F.concat(F.array("points"), F.coalesce("holes", F.array().cast("array<array<struct<x:double,y:double>>>")))
    return outer.join(holes, "ring", "left").select(*_named(keys), F.col("ring").alias("part"), whole.alias("rings"), (F.col("area") + F.coalesce("less", F.lit(0.0))).alias("area"), F.coalesce(F.size("holes"), F.lit(0)).alias("holes"))


def dissolve(polygons: DataFrame, keys: list[str], rings_col: str, node: bool = True) -> DataFrame:
    """(keys, part, rings, area, holes): each group's polygons as one outline. node: edges are split first where members of a group meet without a
    common vertex; without it, edges must be noded already."""
    e = directed(polygons.select(*keys, rings_col), rings_col)
    return nested(rings(outline(noded(e, keys) if node else e, keys), keys), keys)


def lines(segments: DataFrame, keys: list[str], start: str, end: str, undirected: str | None = None) -> DataFrame:
    """(keys, line, points, length, closed): segments (x0, y0, x1, y1) that follow one another at nodes, columns that compare equal where they meet, as
    lines. Lines end where a node has not exactly one segment that comes in and one that goes out. undirected: a unique column; then segments may lie
    either way round, lines end where not exactly two meet, and each line runs so that its least segment goes forward."""
    s = segments.select(_keys(keys), *ENDS, F.col(start).alias("from"), F.col(end).alias("to"), *([F.col(undirected).alias("key"), F.lit(0).alias("way")] if undirected else []))
    if undirected:
        s = s.unionByName(s.select("_k", F.col("x1").alias("x0"), F.col("y1").alias("y0"), F.col("x0").alias("x1"), F.col("y0").alias("y1"), F.col("to").alias("from"), F.col("from").alias("to"), "key", F.lit(1).alias("way")))
    h = scratch(s.withColumn("id", F.monotonically_increasing_id()), "line-parts")
    same = [F.col("h._k").eqNullSafe(F.col("d._k")), F.col("h.to") == F.col("d.node")]
    # Nodes where a line goes on: one way in and one out, or two segments, each of which stands for one of both ways.
    goes = h.groupBy("_k", F.col("from").alias("node")).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("a"), F.max("id").alias("b"), *([F.min(F.struct("id", "key"))["key"].alias("ka")] if undirected else []))
    if undirected:
        # The key comes with the node: looked up by the way out, all ends of lines, which have none, would meet in one task.
        twin = h.alias("h").join(goes.where("n = 2").alias("d"), same, "left")
        # The way out that is not the same segment back; of a segment from a node to itself there is none.
        on = F.when(F.col("h.from") == F.col("h.to"), F.lit(None)).when(F.col("d.ka") != F.col("h.key"), F.col("d.a")).otherwise(F.col("d.b"))
        links = twin.select("h.id", on.alias("next"), F.struct(F.col("h.key").alias("k"), F.col("h.way").alias("w")).alias("label"))
    else:
        comes = h.groupBy("_k", F.col("to").alias("node")).agg(F.count(F.lit(1)).alias("m"))
        on = goes.where("n = 1").alias("h").join(comes.where("m = 1").alias("d"), [F.col("h._k").eqNullSafe(F.col("d._k")), F.col("h.node") == F.col("d.node")]).select("h._k", "h.node", "h.a")
        links = h.alias("h").join(on.alias("d"), same, "left").select("h.id", F.col("d.a").alias("next"), F.struct(*[F.col(f"h.{c}").alias(c) for c in ENDS]).alias("label"))
    part = h.join(ranked(links), "id")
    far = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    way = [F.min(F.struct("key", "way"))["way"].alias("w"), F.min("key").alias("k")] if undirected else [F.lit(0).alias("w"), F.lit(None).alias("k")]
    point = F.struct("place", F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("x1").alias("u"), F.col("y1").alias("v"))
    found = part.groupBy("_k", "chain", "closed").agg(F.array_sort(F.collect_list(point)).alias("p"), F.sum(far).alias("length"), *way).where("w = 0")
    last = F.element_at("p", -1)
    points = F.concat(F.transform("p", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"))), F.array(F.struct(last["u"].alias("x"), last["v"].alias("y"))))
    return found.select(*_named(keys), F.col("k" if undirected else "chain").alias("line"), points.alias("points"), "length", "closed")
