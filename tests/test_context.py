"""Graph context of a table of seeds against a search from each seed by itself."""

import random

import pytest

from loreweave.operators import graph

EDGES = "edge_type string, edge_id long, from_type string, from_id long, to_type string, to_id long"


def made(n, m, seed):
    rng = random.Random(seed)
    ends = lambda: rng.choice([0, 0, 0, *range(n)])  # noqa: E731  node 0 is a hub
    return [(rng.choice("xy"), i, "N", ends(), rng.choice("NM"), ends()) for i in range(m)]


def around(edges, seed, direction, max_depth, limit):
    """Of each node within reach: depth, the first step there and the edges of that pair."""
    steps = {}
    for kind, i, a, ai, b, bi in edges:
        for way, src, dst in (("out", (a, ai), (b, bi)), ("in", (b, bi), (a, ai))):
            if direction in (way, "both"):
                steps.setdefault(src, {}).setdefault(kind, []).append((way != "out", i, dst, way))
    cut = {src: [(after, kind, i, dst, way) for kind, all_ in by.items() for after, i, dst, way in sorted(all_)[:limit]] for src, by in steps.items()}
    seen, level, out = {seed}, [seed], {}
    for depth in range(1, max_depth + 1):
        best, pairs = {}, {}
        for src in level:
            for after, kind, i, dst, way in cut.get(src, []):
                if dst not in seen:
                    pairs[src, dst] = pairs.get((src, dst), 0) + 1
                    best[dst] = min(best.get(dst, ((9,),)), ((after, kind, i, *src), way))
        for dst, ((_, kind, i, *src), way) in best.items():
            out[dst] = (depth, kind, i, way, tuple(src), pairs[tuple(src), dst])
        level = sorted(best)
        seen |= set(best)
    return out


@pytest.mark.parametrize(("direction", "max_depth", "limit"), [("both", 1, 100), ("both", 3, 2), ("out", 2, 100), ("in", 4, 3)])
def test_as_from_each_seed(spark, direction, max_depth, limit):
    """150 seeds, so several blocks of them, one twice, and one that has no edges."""
    edges = made(150, 260, max_depth)
    seeds = [("N", i) for i in range(150)] + [("N", 3), ("M", 999)]
    found = graph.context(spark.createDataFrame(edges, EDGES), spark.createDataFrame(seeds, "type string, id long"), direction=direction, max_depth=max_depth, limit=limit)
    got = {}
    for r in found.collect():
        key = (r["seed_type"], r["seed_id"]), (r["type"], r["id"])
        assert key not in got
        got[key] = (r["depth"], r["edge_type"], r["edge_id"], r["direction"], (r["from_type"], r["from_id"]), r["n_edges"])
    want = {(s, node): told for s in set(seeds) for node, told in around(edges, s, direction, max_depth, limit).items()}
    assert got == want


def test_blocks_share_rows(spark, monkeypatch):
    """64 seeds around one hub travel as one row a node."""
    edges = spark.createDataFrame([("e", i, "A", i, "H", 0) for i in range(64)] + [("e", 100 + i, "H", 0, "B", i) for i in range(50)], EDGES)
    sizes, real = [], graph.held_or_cut
    monkeypatch.setattr(graph, "held_or_cut", lambda rows: (sizes.append((out := real(rows))[1]), out)[1])
    seeds = spark.createDataFrame([("A", i) for i in range(64)], "type string, id long").coalesce(1)
    with_conf = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        found = graph.context(edges, seeds, direction="out", max_depth=2)
        assert found.count() == 64 + 64 * 50
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", with_conf)
    assert max(sizes) <= 115  # not 3200


def test_kinds_as_one_table(spark):
    """Kinds with repeats give what one table of distinct edges gives, also if an edge type leads both ways or to two types."""
    rng, kinds, rows = random.Random(7), [], set()
    for name, a, b in (("x", "N", "N"), ("x", "N", "M"), ("y", "M", "N"), ("z", "K", "K")):
        own = [(i, rng.choice([0, 0, *range(30)]), rng.randrange(300)) for i in range(400)]
        kinds.append(graph.Kind(name, a, b, spark.createDataFrame(own + own[:150], "edge_id long, from_id long, to_id long"), True))
        rows |= {(name, i, a, f, b, t) for i, f, t in own}
    edges = spark.createDataFrame(sorted(rows), EDGES)
    told = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    for n in (3, graph.FEW + 50):
        seeds = spark.createDataFrame([(k, i) for k in "NM" for i in range(n)] + [("none", 1)], "type string, id long")
        for options in ({"limit": 4}, {"limit": 0}, {"limit": None}, {"direction": "in", "limit": 2, "edge_types": ["x"]}, {"direction": "out", "edge_types": ["none"]}):
            assert told(graph.neighbors(kinds, seeds, **options)) == told(graph.neighbors(edges, seeds, **options))
        assert told(graph.context(kinds, seeds, max_depth=2, limit=3)) == told(graph.context(edges, seeds, max_depth=2, limit=3))
    with pytest.raises(ValueError, match="sideways"):
        graph.neighbors(kinds, seeds, direction="sideways")


def test_many_seeds_make_a_hop_once(spark, monkeypatch):
    """Of many seeds, what a hop gives is written without a look before, which would make it twice."""
    seeds = spark.createDataFrame([("N", i) for i in range(graph.FEW + 1)], "type string, id long")
    monkeypatch.setattr(graph, "held_or_cut", lambda rows: pytest.fail("made twice"))
    edges = spark.createDataFrame([("e", i, "N", i, "M", i % 7) for i in range(graph.FEW + 1)], EDGES)
    assert graph.context(edges, seeds, direction="out").count() == graph.FEW + 1


@pytest.mark.parametrize("name", ["neighbors_in", "neighbors_both"])
def test_repeats_need_no_exchange(spark, name):
    """Edges are limited where they are read: lineitem is sent once, and only what the limit leaves of it."""
    from loreweave.plans.driver_queries import QUERIES

    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "WindowGroupLimit" in plan and "keys=[l_" not in plan


def test_empty_and_wrong(spark):
    edges, seeds = spark.createDataFrame(made(5, 9, 1), EDGES), spark.createDataFrame([], "type string, id long")
    assert graph.context(edges, seeds, max_depth=2).count() == 0
    assert graph.context(edges.limit(0), spark.createDataFrame([("N", 1)], "type string, id long")).count() == 0
    with pytest.raises(ValueError, match="max_depth"):
        graph.context(edges, seeds, max_depth=0)
