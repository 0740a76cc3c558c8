"""Paths with limits, at hubs, and where first choices lead nowhere."""

import random
import time

import pytest
from pyspark.sql import functions as F

from loreweave.operators import graph
from loreweave.shared import temporary_tables

EDGES = "edge_type string, edge_id long, from_type string, from_id long, to_type string, to_id long"


def node(spark, kind, ident):
    return spark.createDataFrame([(kind, ident)], "type string, id long")


def walks(rows, start, goal, most):
    """All simple undirected paths from start to goal in order of length and nodes, or from start if goal is None."""
    near = {}
    for _, _, a, x, b, y in rows:
        near.setdefault((a, x), set()).add((b, y))
        near.setdefault((b, y), set()).add((a, x))
    found = []

    def walk(p):
        if (goal is None and len(p) > 1) or p[-1] == goal:
            found.append([f"{t}:{i}" for t, i in p])
        if p[-1] != goal and len(p) <= most:
            for m in near.get(p[-1], ()):
                if m not in p:
                    walk((*p, m))

    walk((start,))
    return sorted(found, key=lambda p: (len(p), p))


@pytest.mark.parametrize("few", [200, 2])
def test_limits_give_the_first_paths(spark, monkeypatch, few):
    """Of random dense graphs, also where levels and paths are written as tables."""
    monkeypatch.setattr(graph, "FEW", few)
    monkeypatch.setattr(graph, "HELD", few)
    rng = random.Random(few)
    rows = [("e", i, rng.choice("AB"), rng.randint(0, 5), rng.choice("AB"), rng.randint(0, 5)) for i in range(24)]
    edges, start = spark.createDataFrame(rows, EDGES), node(spark, "A", 1)
    for goal, limits in ((("B", 2), (4, 1000)), (("A", 1), (3,)), (None, (5, 40))):
        want = walks(rows, ("A", 1), goal, 4)
        for limit in limits:
            to = None if goal is None else node(spark, *goal)
            got = [r["nodes"] for r in graph.paths(edges, start, direction="both", max_depth=4, to=to, limit=limit).collect()]
            assert got == want[:limit]


def test_first_choices_that_lead_nowhere(spark):
    """The first ways from the start return to it and nowhere else, as simple paths mayn't; the wide cut finds the last one."""
    # 0 -> 100..119 -> 0's own second neighbor 1 -> back only through 1; the goal hangs on 1 and on 300
    rows = [("e", 1, "N", 0, "N", 1)] + [("e", 10 + i, "N", 1, "N", 100 + i) for i in range(20)] + [("e", 40 + i, "N", 100 + i, "N", 0) for i in range(20)]
    rows += [("e", 90, "N", 1, "N", 9)]
    edges = spark.createDataFrame(rows, EDGES)
    want = walks(rows, ("N", 0), ("N", 9), 4)
    got = [r["nodes"] for r in graph.paths(edges, node(spark, "N", 0), direction="both", max_depth=4, to=node(spark, "N", 9), limit=len(want) + 5).collect()]
    assert got == want and len(want) > 15
    # walks of four steps exist by going over 1 twice; no simple path does
    trap = [("e", i, "N", 0, "N", i) for i in range(1, 30)] + [("e", 100 + i, "N", i, "N", 50) for i in range(1, 30)] + [("e", 200, "N", 50, "N", 60), ("e", 201, "N", 29, "N", 60)]
    want = walks(trap, ("N", 0), ("N", 60), 4)
    got = [r["nodes"] for r in graph.paths(spark.createDataFrame(trap, EDGES), node(spark, "N", 0), direction="both", max_depth=4, to=node(spark, "N", 60), limit=35).collect()]
    assert got == want[:35]


def test_hub(spark):
    """Two nodes with 10,000 friends each, all in one hub: 10**8 paths of four steps, of which ten are asked for."""
    n = 10_000
    ids = spark.range(n).withColumn("edge_type", F.lit("e"))
    part = lambda a, b, c, d: ids.select("edge_type", F.expr("id AS edge_id"), F.expr(f"{a} AS from_type"), F.expr(f"{b} AS from_id"), F.expr(f"{c} AS to_type"), F.expr(f"{d} AS to_id"))
    edges = part("'P'", "CAST(-1 AS BIGINT)", "'P'", "id").unionByName(part("'P'", "id", "'H'", "CAST(0 AS BIGINT)")).unionByName(part("'P'", "CAST(-2 AS BIGINT)", "'P'", f"id + {n}")).unionByName(part("'P'", f"id + {n}", "'H'", "CAST(0 AS BIGINT)"))
    with temporary_tables(spark):
        edges = graph.cut(edges)
        edges.count()
        began = time.time()
        got = graph.paths(edges, node(spark, "P", -1), direction="both", max_depth=4, to=node(spark, "P", -2), limit=10).collect()
        took = time.time() - began
        friends, others = sorted(f"P:{i}" for i in range(n)), sorted(f"P:{i}" for i in range(n, 2 * n))
        assert [r["nodes"] for r in got] == [["P:-1", friends[0], "H:0", b, "P:-2"] for b in others[:10]]
        assert took < 60, took
        first = graph.paths(edges, node(spark, "H", 0), direction="both", max_depth=3, limit=5).collect()
        assert [r["nodes"] for r in first] == [["H:0", x] for x in sorted(friends + others)[:5]]


def test_hub_plan_has_no_product(spark):
    """What follows a hub is cut to as many as can be wanted before it meets paths."""
    rows = [("e", i, "N", 0, "N", i) for i in range(1, 3000)]
    edges = spark.createDataFrame(rows, EDGES)
    here = graph._trivial(spark.createDataFrame([("N", i) for i in range(1, 150)], "type string, id long"))
    two, n = graph._extended(here, graph.arrows(edges, "both"), 150, 1)
    assert n == 149
    seen = []
    real = graph.held_or_cut
    graph.held_or_cut = lambda rows: (seen.append(rows), real(rows))[1]
    try:
        graph._extended(two, graph.arrows(edges, "both"), 50, 2)
    finally:
        graph.held_or_cut = real
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "TakeOrderedAndProject" in plan
