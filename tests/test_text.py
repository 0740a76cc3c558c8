import random
import re

import pytest
from pyspark.sql import functions as F

from loreweave.functions.text import chunk_by_sentence, chunk_text, content_hash, segment
from loreweave.operators.index import postings, stored_postings
from loreweave.plans.engine import dictionary
from loreweave.functions.vector import cosine


def run(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t")).alias("x")).collect()]


def expected_chunks(text, size, overlap):
    if len(text) <= size:
        return [text] if text else []
    step, out = size - overlap, []
    for s in range(0, len(text), step):
        w = text[s : s + size]
        if len(w) < size // 2 and out:
            out[-1] += w
        else:
            out.append(w)
    return [c.strip() for c in out if c.strip()]


@pytest.mark.parametrize(("size", "overlap"), [(800, 100), (120, 100), (333, 50), (100, 0), (7, 3)])
def test_chunks(spark, size, overlap):
    rng = random.Random(size)
    texts = ["", "short", "   ", "x" * size, "y" * 2 * size, "z" * 10_000, "é　 中文🙂 " * 200, " " * (3 * size)]
    texts += ["".join(rng.choice("ab \n中é") for _ in range(rng.randint(0, 4 * size))) for _ in range(60)]
    assert run(spark, texts, lambda c: chunk_text(c, size, overlap)) == [expected_chunks(t, size, overlap) for t in texts]


def test_chunks_refuse_steps_that_never_end():
    with pytest.raises(ValueError):
        chunk_text(F.col("t"), 100, 100)


def expected_sentences(text, size):
    if len(text) <= size:
        return [text] if text else []
    ends = re.compile(r"[。！？.!?]\s*")
    seps, out, cur = [*ends.findall(text), ""], [], ""
    for s, sep in zip(ends.split(text), seps, strict=True):
        if len(cur) + len(s + sep) > size:
            if cur:
                out.append(cur.strip())
            cur = s + sep
        else:
            cur += s + sep
    return [*out, cur.strip()] if cur else out


def test_sentences(spark):
    rng = random.Random(5)
    texts = ["", "One.", "A. " * 30, "no end " * 20] + ["".join(rng.choice("ab .!?。\n") for _ in range(rng.randint(0, 200))) for _ in range(80)]
    assert run(spark, texts, lambda c: chunk_by_sentence(c, 40)) == [expected_sentences(t, 40) for t in texts]


def test_segments_and_hashes(spark):
    assert run(spark, ["Hello, Wörld 42!", "我爱中文x", "", None], segment) == ["hello wörld 42", "我爱 爱中 中文 x", "", None]
    assert run(spark, ["abc"], content_hash) == ["900150983cd24fb0d6963f7d28e17f72"]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 2.0], 0.0), ([0.0, 0.0], [1.0, 1.0], None), ([1.0], [1.0, 1.0], None)]
    df = spark.createDataFrame([(a, b) for a, b, _ in rows], "a array<float>, b array<float>")
    assert [r[0] for r in df.select(cosine(F.col("a"), F.col("b"))).collect()] == [x for _, _, x in rows]


def test_dictionary(spark):
    """Terms of a dictionary stay whole, the longest first."""
    words = dictionary("东京 3 n\n\n东京都\nC++\nnew york\n")
    assert words == ["东京", "东京都", "C++", "new"] and dictionary("") == []
    texts = ["我在东京都里面", "东京人", "use c++ now", "renewed a new", "中文字", "", "a.b"]
    assert run(spark, texts, lambda c: segment(c, words)) == ["我在 东京都 里面", "东京 人", "use c++ now", "renewed a new", "中文 文字", "", "a b"]


def test_postings_count_words_inside_rows(spark):
    rows = spark.createDataFrame([(1, "b a b, A c"), (2, ""), (3, None), (4, "?!"), (5, "b"), (6, "东京都 x 东京")], "id long, content string")
    found = {(r.id, r.dl, r.term, r.tf) for r in postings(rows).collect()}
    assert found == {(1, 5, "a", 2), (1, 5, "b", 2), (1, 5, "c", 1), (5, 1, "b", 1), (6, 4, "东京", 2), (6, 4, "京都", 1), (6, 4, "x", 1)}
    kept = rows.select(F.lit("t").alias("source_table"), "id", segment(F.col("content")).alias("fts_content"))
    stored = stored_postings(kept)
    assert {(r.id, r.dl, r.term, r.tf) for r in stored.collect()} == found
    assert "Aggregate" not in stored._jdf.queryExecution().executedPlan().toString()
