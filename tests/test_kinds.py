"""Colours of nodes of a kind, which are neighbours of one another and have the same others: by kinds as node by node."""

import random
from collections import defaultdict

import duckdb
import pytest

from meridia.operators import graph
from meridia.operators import spatial as G
from meridia.plans import QUERIES
from meridia.sources.views import with_views

from .test_copies import copies  # noqa: F401


def crowd():
    """Ids with their kinds, edges between kinds, and the neighbours of each id."""
    rng = random.Random(6)
    kinds = [k for k in range(30) for _ in range(rng.choice([1, 1, 2, 9]))]
    rng.shuffle(kinds)
    edges = sorted({tuple(sorted(rng.sample(range(30), 2))) for _ in range(90)})
    met = {*edges, *((b, a) for a, b in edges), *((k, k) for k in range(30))}
    near = {i: [j for j, m in enumerate(kinds) if j != i and (k, m) in met] for i, k in enumerate(kinds)}
    return kinds, edges, near


def first_free(near, order):
    done = {}
    for i in order:
        used = {done[j] for j in near[i] if j in done}
        done[i] = next(c for c in range(len(near)) if c not in used)
    return done


@pytest.mark.parametrize("in_block", [graph.IN_BLOCK, 40, 8])
def test_greedy_colours_by_kinds(spark, monkeypatch, in_block):
    monkeypatch.setattr(graph, "IN_BLOCK", in_block)
    kinds, edges, near = crowd()
    nodes = spark.createDataFrame(list(enumerate(kinds)), "id long, kind long")
    got = graph.greedy_colours(nodes, spark.createDataFrame(edges, "src long, dst long"), same="kind")
    assert {r.id: r.colour for r in got.collect()} == first_free(near, sorted(near, key=lambda i: (-len(near[i]), i)))


def test_many_colours_of_one_kind(spark):
    # More colours than a word of bits holds, and than the words that there are at first.
    nodes = spark.range(300).selectExpr("id", "id % 2 AS kind")
    got = graph.greedy_colours(nodes, spark.createDataFrame([(0, 1)], "src long, dst long"), same="kind")
    assert [r.colour for r in got.orderBy("id").collect()] == list(range(300))


@pytest.mark.parametrize("in_block", [graph.IN_BLOCK, 40])
def test_palette_colours_by_kinds(spark, monkeypatch, in_block):
    # The same as with all edges between nodes.
    kinds, edges, near = crowd()
    palette = spark.createDataFrame([(i, c) for i, c in enumerate(("#e6194b", "#3cb44b", "#ffe119", "#4363d8", "#46f0f0"))], "place int, colour string")
    nodes = spark.createDataFrame([(i, k, "#123456" if i % 9 == 0 else None) for i, k in enumerate(kinds)], "id long, kind long, fixed string")
    each = spark.createDataFrame([(i, j) for i in near for j in near[i] if i < j], "src long, dst long")
    want = sorted(graph.palette_colours(nodes, each, palette).collect())
    monkeypatch.setattr(graph, "IN_BLOCK", in_block)
    assert sorted(graph.palette_colours(nodes, spark.createDataFrame(edges, "src long, dst long"), palette, same="kind").collect()) == want


@pytest.mark.parametrize("name", ["i6_colouring", "i6_palette_colouring"])
def test_equal_zones_make_no_more_pairs(spark, copies, monkeypatch, name):  # noqa: F811
    pairs, box_pairs = [], G.box_pairs

    def counted(*args, **kwargs):
        out = box_pairs(*args, **kwargs)
        pairs.append(out.count())
        return out

    monkeypatch.setattr(G, "box_pairs", counted)
    got = {r.id: r.colour for r in QUERIES[name](spark, copies).collect()}
    assert sum(pairs) <= 10 * 10 and len(got) == 200  # ten places of two hundred zones
    if name == "i6_colouring":
        c = duckdb.connect()
        c.execute(f"CREATE VIEW supplier AS SELECT * FROM read_parquet('{copies}/supplier.parquet')")
        near = defaultdict(list)
        for a, b in c.execute(with_views("SELECT a.zone_id, b.zone_id FROM zones a JOIN zones b ON a.zone_id <> b.zone_id AND a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax")).fetchall():
            near[a].append(b)
        assert got == first_free(near, sorted(got, key=lambda i: (-len(near[i]), i)))
