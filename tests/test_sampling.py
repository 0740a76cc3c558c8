"""Samples by hash: against a plain version, merged, and as estimates."""

import hashlib
import math
import random

import pytest

from loreweave.operators import index, sampling

SCHEMA = "id long, s string, w double"


def rows(n, seed=0):
    rng = random.Random(seed)
    return [(i, rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice([0.5, 1.0, 4.0, 0.0, -1.0, None, math.nan, math.inf])) for i in range(n)]


def share(key, salt=""):
    return (int(hashlib.md5(f"{salt}:{key}".encode()).hexdigest()[:13], 16) + 1) / 2**52


def wanted(data, k, strata, weighted):
    by = {}
    for i, s, w in data:
        if weighted and not (w is not None and 0 < w < math.inf):
            continue
        by.setdefault(s if strata else None, []).append((-math.log(share(i)) / w if weighted else share(i), i, w))
    out = {}
    for own in by.values():
        own.sort()
        bound = own[k][0] if len(own) > k else None
        for _, i, w in own[:k]:
            out[i] = 1.0 if bound is None else 1 - math.exp(-w * bound) if weighted else bound
    return out


@pytest.mark.parametrize("strata", [[], ["s"]])
@pytest.mark.parametrize("weight", [None, "w"])
def test_sample(spark, strata, weight):
    data = rows(400)
    df = spark.createDataFrame(data, SCHEMA)
    for k in (0, 1, 25, 1000):
        sketch = sampling.bottom(df, k, "id", strata=strata, weight=weight)
        got = {r["id"]: r["chance"] for r in sampling.sample(sketch, k, strata=strata, weight=weight).collect()}
        assert got == pytest.approx(wanted(data, k, strata, weight))
    parts = [sampling.bottom(df.filter(f"id % 3 = {i}").repartition(5), 25, "id", strata=strata, weight=weight) for i in range(3)]
    whole = sampling.merged(parts, 25, strata=strata)
    assert {r["id"] for r in whole.collect()} == {r["id"] for r in sampling.bottom(df, 25, "id", strata=strata, weight=weight).collect()}


def test_estimates(spark):
    """Sums over samples of many salts are on the average those over all rows."""
    data = [(i, "x", 1.0 + i % 7) for i in range(500)]
    df = spark.createDataFrame(data, SCHEMA)
    for weight in (None, "w"):
        told = []
        for salt in range(12):
            got = sampling.sample(sampling.bottom(df, 60, "id", weight=weight, salt=str(salt)), 60, weight=weight)
            told.append(sum(r["w"] / r["chance"] for r in got.collect()))
        assert sum(told) / len(told) == pytest.approx(sum(w for *_, w in data), rel=0.08)


def test_awkward(spark):
    df = spark.createDataFrame([(None, "a", 1.0), (1, "a", 1.0), (1, "a", 1.0), (1, "a", 2.0)], SCHEMA)
    assert sampling.sample(sampling.bottom(df, 2, "id"), 2).count() == 2  # a null key is never picked
    assert sampling.sample(sampling.bottom(df, 5, "id"), 5).count() == 3
    assert sampling.sample(sampling.bottom(df.limit(0), 5, "id", strata=["s"]), 5, strata=["s"]).count() == 0
    with pytest.raises(ValueError, match="negative"):
        sampling.bottom(df, -1, "id")


def test_sketches_merge(spark):
    """Merged sketches of slices tell what those of all rows tell, near the exact numbers; nulls and no rows at all."""
    rng = random.Random(6)
    data = [(rng.choice(["a", "b", "c"]), i, " ".join(f"w{rng.randint(0, 3000)}" for _ in range(rng.randint(1, 30)))) for i in range(3000)]
    data += [("d", 1, None), (None, 2, "x y z"), ("e", 3, "")]
    df = spark.createDataFrame(data, "source_table string, source_id long, fts_content string")
    told = index.estimates(index.merged_sketches(index.sketches(df)), [0.5]).first()
    assert told["documents"] == pytest.approx(3001, rel=0.05)
    assert told["terms"] == pytest.approx(len({w for *_, t in data for w in (t or "").split()}), rel=0.05)
    sizes = sorted(len(t.split()) for *_, t in data if t is not None)
    assert abs(sizes.index(told["tokens"][0]) / len(sizes) - 0.5) < 0.06
    by = {r["source_table"]: r for r in index.estimates(index.sketches(df)).collect()}
    assert set(by) == {"a", "b", "c", "d", "e", None} and by["d"]["terms"] == by["e"]["terms"] == 0 and by[None]["terms"] == 3
    assert index.sketches(df.limit(0)).count() == 0


def test_index_sketches_make_tokens_once(spark):
    """What is merged and what is exact are read from stored tokens."""
    from loreweave.plans.driver_queries import QUERIES

    plan = QUERIES["index_sketches"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan
