"""Vector search through clusters: the same as over all vectors, with fewer of them scored."""

import random

import pytest
from pyspark.sql import functions as F

from loreweave.functions.vector import literal
from loreweave.operators import search, vectors

SCHEMA = "id long, kind string, vector array<float>"


def some(n, length, groups, seed=0, spread=0.1):
    """Vectors around some directions, of any size."""
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(length)] for _ in range(groups)]
    rows = []
    for i in range(n):
        size = rng.choice([0.01, 1.0, 50.0])
        rows.append((i, "ab"[i % 2], [size * (x + rng.gauss(0, spread)) for x in rng.choice(middles)]))
    return rows


def plain(rows, query, limit, keep=None):
    own = rows if keep is None else rows.filter(keep)
    return [tuple(r) for r in search.top(search.vector_scores(own, literal(query)).select("id", "score"), limit).collect()]


@pytest.mark.parametrize(("n", "groups", "limit"), [(1, 1, 3), (300, 9, 5), (300, 300, 40), (60, 3, 100)])
def test_same_as_all_vectors(spark, n, groups, limit):
    data = some(n, 6, groups, n)
    rows = spark.createDataFrame(data, SCHEMA)
    held = vectors.clustered(rows, 6)
    assert held.rows.count() == n and set(held.rows.columns) == {"id", "kind", "vector", "norm", "cluster", "distance"}
    for query in (data[0][2], [1.0, 0, 0, 0, 0, 0], [-x for x in data[-1][2]]):
        assert [tuple(r) for r in vectors.nearest(held, query, limit).collect()] == plain(rows, query, limit)
    keep = F.col("kind") == "b"
    assert [tuple(r) for r in vectors.nearest(held, data[0][2], limit, keep=keep).collect()] == plain(rows, data[0][2], limit, keep)


def test_few_are_scored(spark, monkeypatch):
    rows = spark.createDataFrame(some(3000, 12, 40, 5), SCHEMA)
    held = vectors.clustered(rows, 12)
    seen = []
    real = vectors.scored
    monkeypatch.setattr(vectors, "scored", lambda own, *a: (seen.append(own), real(own, *a))[1])
    query = rows.filter("id = 17").first()["vector"]
    assert [tuple(r) for r in vectors.nearest(held, query, 10).collect()] == plain(rows, query, 10)
    assert sum(own.count() for own in seen) < 600


def test_copies_of_one_vector(spark):
    """More than half of all rows are one vector, so scores tie over a whole cluster and beyond the limit."""
    copies = [(1000 + i, "a", [1.0, 2.0, 3.0, 4.0]) for i in range(150)]
    for data in (some(100, 4, 5, 2) + copies, copies):
        rows = spark.createDataFrame(data, SCHEMA)
        held = vectors.clustered(rows, 4)
        for query in ([1.0, 2.0, 3.0, 4.0], [4.0, 3.0, 2.0, 1.0]):
            assert [tuple(r) for r in vectors.nearest(held, query, 30).collect()] == plain(rows, query, 30)


def test_vectors_without_place(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, "a", None), (2, "a", [0.0, 0.0]), (3, "a", [1.0]), (4, "a", [1.0, nan]), (5, "a", [inf, 1.0]), (6, "a", [3.0, 4.0]), (6, "a", [3.0, 4.0])]
    held = vectors.clustered(spark.createDataFrame(data, SCHEMA), 2)
    assert [tuple(r) for r in vectors.nearest(held, [3.0, 4.0], 5).collect()] == [(6, 1.0)] * 2
    for query in ([0.0, 0.0], [1.0], [nan, 1.0]):
        assert vectors.nearest(held, query, 5).count() == 0
    assert vectors.nearest(held, [1.0, 1.0], 0).count() == 0
    none = vectors.clustered(spark.createDataFrame(data[:5], SCHEMA), 2)
    assert none.rows.count() == none.heads.count() == vectors.nearest(none, [1.0, 1.0], 5).count() == 0


def test_kept_on_disk(spark, tmp_path):
    data = some(200, 5, 8, 9)
    rows = spark.createDataFrame(data, SCHEMA)
    vectors.clustered(rows, 5, fit_rows=20).write(str(tmp_path))
    held = vectors.Clustered.read(spark, str(tmp_path))
    assert [tuple(r) for r in vectors.nearest(held, data[3][2], 7).collect()] == plain(rows, data[3][2], 7)


def test_ring():
    assert vectors.ring([(0, 1.0, 0.2, 0.4), (1, 1.0, 0.2, 0.9), (2, 0.1, 0.0, 0.05)], 0.3) == [(1, 0.7, 0.9), (2, 0.0, 0.05)]
