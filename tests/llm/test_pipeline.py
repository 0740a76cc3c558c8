"""The pipeline against brute force of its decisions."""

import re

import numpy as np
import public_tokenizers as P
from pyspark.sql import functions as F

import corpus_pipeline
from loreweave.llm.bpe_codec import codec
from loreweave.llm.language_id import language_id
from tests.llm.test_operators import SF, brute_hits, links


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = docs.filter("doc_id < 12").withColumn("doc_id", F.lit(None).cast("long")).limit(3).unionByName(docs.limit(2)).unionByName(docs.limit(1).withColumn("text", F.lit("12 34")))
    docs = docs.unionByName(extra).coalesce(1)
    path = "file://" + spark.conf.get("spark.checkpoint.dir").removeprefix("file://") + "/pipeline-input"
    docs.write.mode("overwrite").parquet(path)
    docs = spark.read.parquet(path)
    rows = [r.asDict() for r in docs.collect()]
    said = language_id(docs.withColumn("row", F.lit(1)), carry=True).select("lang_pred", "score", "row.text", "row.doc_id").collect()
    good = {(r["doc_id"], r["text"]) for r in said if r["lang_pred"] != "und" and r["score"] >= corpus_pipeline.LEAST_SCORE}
    kept = [r for r in rows if (r["doc_id"], r["text"]) in good]
    assert len(rows) - 10 < len(kept) < len(rows)
    seen, distinct = set(), []
    for r in kept:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", r["text"])
        if t not in seen:
            distinct.append(r)
        seen.add(t)
    near = links([(i, r["text"]) for i, r in enumerate(distinct)], 5, 80)
    single = [r for i, r in enumerate(distinct) if near[i][2]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    clean = [r for i, r in enumerate(single) if not brute_hits([(i, r["text"])], items, 10)[i][4]]
    stage = docs
    for (name, f), want in zip(corpus_pipeline.STAGES[:4], (kept, distinct, single, clean), strict=True):
        f(spark, stage, SF).write.mode("overwrite").parquet(f"{path}-{name}")
        stage = spark.read.parquet(f"{path}-{name}")
        assert stage.columns == docs.columns
        assert sorted(t["text"] for t in stage.collect()) == sorted(r["text"] for r in want), name
    out = corpus_pipeline.encode(spark, stage, SF).collect()
    c = codec(P.path("byte_bpe_50k.tiktoken"))
    assert sorted(c.decode(np.array(r["ids"], "<u4").tobytes()).decode() for r in out) == sorted(r["text"] for r in clean)


def test_run(spark):
    assert 0 < corpus_pipeline.run(spark, SF).count() < spark.read.parquet(f"{SF}/documents.parquet").count()


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_stages_carry_any_columns(spark, tmp_path):
    """Other columns have the names that stages and operators use inside, or dots; ids and texts may be null."""
    source = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").filter("lang = 'en' AND n_chars > 400").orderBy("doc_id").limit(3).collect()]
    item = " ".join(f"bench{i}" for i in range(12))
    near = " ".join(f"word{i}" for i in range(200))
    rows = [(7, source[0]), (3, source[0].replace(" ", "  ")), (None, source[0]), (9, near), (8, near + " more"), (5, f"here {item} there"), (6, None), (None, None), (4, ""), (2, "12 34")]
    other = {"row": 1, "row_number": 2, "Row_Number_": 3, "__row": 4, "a.b": 5, "hash": 6, "text_sha256": 7, "n": 8, "id": 9, "g": 10}
    schema = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` long" for c in other)
    docs = spark.createDataFrame([(i, t, "en", *other.values()) for i, t in rows], schema)
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (None, None), (2, "")], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")

    def after(f):
        out = f(spark, docs, f"file://{tmp_path}")
        assert out.columns == docs.columns
        got = [tuple(r) for r in out.collect()]
        assert all(r[3:] == tuple(other.values()) for r in got)
        return sorted((r[0] is None, r[0] or 0, r[1] or "") for r in got)

    def of(*kept):
        return sorted((rows[k][0] is None, rows[k][0] or 0, rows[k][1] or "") for k in kept)

    assert after(corpus_pipeline.identify_language) == of(0, 1, 2, 3, 4, 5)
    assert after(corpus_pipeline.drop_exact_copies) == of(1, 3, 4, 5, 8, 9)
    assert after(corpus_pipeline.drop_near_copies) == of(1, 4, 5, 6, 7, 8, 9)
    assert after(corpus_pipeline.drop_contaminated) == of(0, 1, 2, 3, 4, 6, 7, 8, 9)
    assert corpus_pipeline.encode(spark, docs, f"file://{tmp_path}").count() == len(rows)
