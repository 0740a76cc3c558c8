"""Top documents from postings in blocks: the same as from all postings, with fewer of them read."""

import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import index, search

SCHEMA = "id long, term string, tf long, dl long"


def made(spark, n, seed=0, rare=None):
    """Postings of random documents; ``rare``: ids that score far above the others."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        dl = rng.randint(20, 60) if rare is None else 50
        for term in "abc":
            if rng.random() < 0.6:
                rows.append((i, term, rng.randint(1, 3), dl))
        if rare and i in rare:
            rows.append((i, "d", 15 + i % 4, dl))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize(("size", "limit"), [(1, 5), (7, 5), (16, 1), (64, 30), (1024, 500)])
def test_same_as_all_postings(spark, size, limit):
    posts = made(spark, 200, size)
    blocks = index.block_postings(posts, size)
    for terms in (["a", "c"], ["b"], ["a", "none"], ["none"], []):
        want = search.top(search.bm25_postings(posts, terms, 200, 40.0), limit).collect()
        got = search.bm25_blocks(blocks, terms, 200, 40.0, limit).collect()
        assert [r["id"] for r in got] == [r["id"] for r in want] and [r["score"] for r in got] == pytest.approx([r["score"] for r in want])


def test_blocks_that_cannot_win_are_not_read(spark, monkeypatch):
    """Of 100 blocks of ids, few can have one of the best five."""
    posts = made(spark, 2000, 3, rare={11, 700, 701, 1400, 1990, 1999})
    blocks = index.block_postings(posts, 20)
    read = []
    real = search.bm25_in_blocks
    monkeypatch.setattr(search, "bm25_in_blocks", lambda some, *a: (read.append(some), real(some, *a))[1])
    got = search.bm25_blocks(blocks, ["a", "b", "d"], 2000, 50.0, 5).collect()
    want = search.top(search.bm25_postings(posts, ["a", "b", "d"], 2000, 50.0), 5).collect()
    assert [r["id"] for r in got] == [r["id"] for r in want]
    seen = {r["block"] for some in read for r in some.select("block").distinct().collect()}
    assert len(seen) <= 10 < blocks.select("block").distinct().count() == 100


def test_blocks(spark):
    posts = spark.createDataFrame([(5, "x", 2, 9), (3, "x", 4, 7), (12, "x", 1, 3), (3, "y", 1, 7)], SCHEMA)
    got = {(r["term"], r["block"]): (r["n"], r["max_tf"], r["min_dl"], [tuple(x) for x in r["rows"]]) for r in index.block_postings(posts, 10).collect()}
    assert got == {("x", 0): (2, 4, 7, [(3, 4, 7), (5, 2, 9)]), ("x", 10): (1, 1, 3, [(2, 1, 3)]), ("y", 0): (1, 1, 7, [(3, 1, 7)])}
    assert index.block_postings(posts.limit(0)).count() == 0 and search.bm25_blocks(index.block_postings(posts.limit(0)), ["x"], 0, 1.0, 3).count() == 0


def test_stored_blocks_are_blocks_of_postings(spark):
    """Blocks from stored tokens, made without a row for each posting in an exchange, are those of their postings."""
    rng = random.Random(4)
    rows = [(i, None if i % 17 == 3 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 30)))) for i in range(-20, 200)]
    df = spark.createDataFrame(rows, "id long, fts_content string").withColumn("source_table", F.lit("t"))
    told = lambda blocks: sorted((r["term"], r["block"], r["n"], r["max_tf"], r["min_dl"], [tuple(x) for x in r["rows"]]) for r in blocks.collect())
    blocks = index.stored_block_postings(df, 16)
    assert told(blocks) == told(index.block_postings(index.stored_postings(df), 16)) and told(index.stored_block_postings(df.limit(0), 16)) == []
    assert "hashpartitioning(block" in plan_of(blocks) and "hashpartitioning(term" not in plan_of(blocks)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_once(spark, tmp_path):
    """Searching them, which looks at its input several times, makes no tokens anew."""
    df = spark.createDataFrame([(i, f"w{i % 7} x") for i in range(50)], "id long, fts_content string").withColumn("source_table", F.lit("t"))
    posts = index.stored_postings(df)
    assert "Generate" not in plan_of(posts)
    assert search.bm25_postings(posts, ["w3"], 50, 2.0).count() == 7
