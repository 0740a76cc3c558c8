"""Every query over the driver's tables against its SQL, and the registry itself."""

import random

import pytest

from loreweave.operators import graph, index, joins
from loreweave.plans.driver_queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, oracle, name):
    oracle(QUERIES[name](spark, SF), ORACLE_SQL[name])


def test_registry(spark):
    import __spark_entry__ as e

    assert set(ORACLE_SQL) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(e.entry(spark).collect()) == 20


def test_neighbors_without_limit(spark):
    edges = spark.createDataFrame([("e", i, "A", 1, "B", i) for i in range(300)], "edge_type string, edge_id long, from_type string, from_id long, to_type string, to_id long")
    seeds = spark.createDataFrame([("A", 1)], "type string, id long")
    assert [graph.neighbors(edges, seeds, **o).count() for o in ({"limit": None}, {}, {"limit": 7})] == [300, 100, 7]


def test_asof_join(spark):
    """A key that has most rows, times on both sides at once, null keys and times, and names that both sides have."""
    rng = random.Random(8)
    key = lambda: rng.choice([1, 1, 1, 2, 3, None])
    left = [(i, key(), rng.choice([None, *range(60)])) for i in range(300)]
    right = [(key(), rng.choice([None, *range(60)]), rng.randint(0, 99)) for _ in range(200)]
    got = joins.asof_join(spark.createDataFrame(left, "row long, k long, at long"), spark.createDataFrame(right, "k long, at long, v long"), ["k"], "at", ["v"])
    want = []
    for i, k, at in left:
        seen = [(t, v) for kk, t, v in right if k is not None and kk == k and None not in (t, at) and t <= at]
        want.append((i, k, at, max(seen)[1] if seen else None))
    assert sorted(map(tuple, got.collect())) == sorted(want, key=lambda r: r[0])
    empty = spark.createDataFrame([], "k long, at long, v long")
    assert [r["v"] for r in joins.asof_join(spark.createDataFrame([(1, 2)], "k long, at long"), empty, ["k"], "at", ["v"]).collect()] == [None]


@pytest.mark.parametrize("keys", [["k"], []])
def test_interval_join(spark, keys):
    """Spans of all lengths, also of one point, below zero, reversed or with nulls, against all pairs."""
    rng = random.Random(len(keys))

    def some(n):
        out = [(0, 1, 5, 5), (1, 1, None, 3), (2, 1, 9, 2), (3, None, 0, 9), (4, 2, -(1 << 50), 1 << 50)]
        for i in range(5, n):
            a = rng.randint(-200, 200)
            out.append((i, rng.choice([1, 1, 1, 2, None]), a, a + rng.choice([0, 1, 2, 3, 7, 8, 60, 300, 5000])))
        return out

    left, right = some(70), some(60)
    l_df, r_df = spark.createDataFrame(left, "l long, k long, a long, b long"), spark.createDataFrame(right, "r long, k long, from long, to long")
    r_df = r_df if keys else r_df.withColumnRenamed("k", "rk")
    got = joins.interval_join(l_df, r_df, keys, ("a", "b"), ("from", "to"))
    assert set(got.columns) == {"l", "k", "a", "b", "r", "from", "to"} | ({"rk"} if not keys else set())
    good = lambda x: None not in x[2:] and x[2] <= x[3]
    want = [(x[0], y[0]) for x in left for y in right if good(x) and good(y) and x[2] <= y[3] and y[2] <= x[3] and (not keys or (x[1] is not None and x[1] == y[1]))]
    assert sorted(map(tuple, got.select("l", "r").collect())) == sorted(want)
    assert joins.interval_join(l_df.limit(0), r_df, keys, ("a", "b"), ("from", "to")).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_embed_missing_tries_thrice(spark, tmp_path):
    """The first content answers at its third try, the other never; a try is a line of its file."""

    def embed(texts):
        with open(tmp_path / texts[0], "a+") as f:
            f.write("x\n")
            f.seek(0)
            tries = len(f.readlines())
        if texts[0] == "never" or tries < 3:
            raise OSError("no answer")
        return [[1.0]]

    rows = spark.createDataFrame([("h1", "late", None), ("h2", "never", None)], "content_hash string, content string, vector array<float>")
    got = {r["content_hash"]: (r["vector"], r["error"]) for r in index.embed_missing(rows, embed, batch=1, pause=0).collect()}
    assert got == {"h1": ([1.0], None), "h2": (None, "OSError('no answer')")}
    assert (tmp_path / "never").read_text() == "x\n" * 3
