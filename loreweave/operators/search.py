"""Vector, full-text and hybrid search as DataFrame plans."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.functions.text import tokens
from loreweave.functions.vector import cosine
from loreweave.shared import cut, values

K1, B = 1.2, 0.75


def vector_scores(rows: DataFrame, query: Column, vector: str = "vector") -> DataFrame:
    """Rows with a vector, scored by cosine similarity; those without a defined similarity are left out."""
    return rows.filter(F.col(vector).isNotNull()).withColumn("score", F.round(cosine(F.col(vector), query), 6)).filter("score is not null")


def bm25_scores(rows: DataFrame, terms: Sequence[str], text: str, keep: Column | None = None, key: str = "id") -> DataFrame:
    """key and score of the rows that match any of the distinct terms, by BM25; statistics are over all rows, ``keep``
    filters after.

    Texts are tokenised once: lengths and term frequencies are written to the shared folder, from where statistics, one
    row of document frequencies, number and mean length, and scores are read. For a corpus that is searched often, see
    bm25_postings.
    """
    terms = list(dict.fromkeys(terms))
    if not terms:
        return rows.select(key, F.lit(0.0).alias("score")).limit(0)
    # a generator of one row keeps the optimizer from putting the token expression in place of each of its uses
    split = rows.select(key, (keep if keep is not None else F.lit(True)).alias("__keep"), F.explode(F.array(tokens(F.col(text)))).alias("__t"))
    some = split.select(key, "__keep", F.size("__t").alias("__dl"), F.explode(F.array(F.filter("__t", lambda x: x.isin(terms)))).alias("__m"))
    tf = [(F.size("__m") - F.size(F.array_remove("__m", t))).alias(f"__tf{i}") for i, t in enumerate(terms)]
    counted = cut(some.select(key, "__keep", "__dl", *tf))
    found = [F.count_if(F.col(f"__tf{i}") > 0).alias(f"__df{i}") for i in range(len(terms))]
    # a null text has no tokens, and no length either
    stats = counted.filter("__dl is not null").agg(F.count(F.lit(1)).alias("__n"), F.avg("__dl").alias("__avg"), *found)
    hit = counted.filter(F.col("__keep") & (F.greatest(*[F.col(f"__tf{i}") for i in range(len(terms))], F.lit(0)) > 0)).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        f, df = F.col(f"__tf{i}").cast("double"), F.col(f"__df{i}")
        idf = F.log((F.col("__n") - df + F.lit(0.5)) / (df + F.lit(0.5)) + F.lit(1.0))
        score = score + idf * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("__dl") / F.col("__avg")))
    return hit.select(key, F.round(score, 6).alias("score"))


def bm25_postings(posts: DataFrame, terms: Sequence[str], n: int, average: float, keep: Column | None = None) -> DataFrame:
    """id and score from a table of postings (see index.postings); only the terms' postings are read.

    Statistics are over all of them, ``keep`` filters after.
    """
    own = posts.filter(F.col("term").isin(list(dict.fromkeys(terms))))
    df = own.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    tf = F.col("tf").cast("double")
    part = F.log((F.lit(float(n)) - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("dl") / F.lit(average)))
    hit = own.filter(keep) if keep is not None else own
    return hit.join(F.broadcast(df), "term").groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))  # a row for each query term


def _part(tf: Column, dl: Column, idf: Column, average: float) -> Column:
    """What a term adds to a score: more with tf, less with the length."""
    tf = tf.cast("double")
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / F.lit(average)))


def block_bounds(blocks: DataFrame, terms: Sequence[str], n: int, average: float) -> tuple[DataFrame, dict[str, float]]:
    """block and bound, which no document of the block scores above, from the heads of the terms' blocks alone; and the
    terms' inverse document frequencies.
    """
    heads = cut(blocks.filter(F.col("term").isin(list(dict.fromkeys(terms)))).select("term", "block", "n", "max_tf", "min_dl"))
    idf = {r["term"]: math.log((n - r["df"] + 0.5) / (r["df"] + 0.5) + 1.0) for r in heads.groupBy("term").agg(F.sum("n").alias("df")).collect()}  # a row for each query term
    return heads.groupBy("block").agg(F.sum(_part(F.col("max_tf"), F.col("min_dl"), _by_term(idf), average)).alias("bound")), idf


def _by_term(idf: dict[str, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in idf.items() for x in pair]), F.col("term")) if idf else F.lit(0.0)


def bm25_in_blocks(blocks: DataFrame, idf: dict[str, float], average: float) -> DataFrame:
    """id and score of the documents in some blocks of the terms."""
    rows = blocks.select("term", "block", F.inline("rows")).select((F.col("block") + F.col("at")).alias("id"), _part(F.col("tf"), F.col("dl"), _by_term(idf), average).alias("part"))
    return rows.groupBy("id").agg(F.round(F.sum("part"), 6).alias("score"))


def bm25_blocks(blocks: DataFrame, terms: Sequence[str], n: int, average: float, limit: int) -> DataFrame:
    """The ``limit`` best documents by BM25 (id, score) from postings in blocks (see index.block_postings), as
    bm25_postings and top() give them.

    The blocks with the highest bounds, as many as documents are wanted, are scored first. No block whose bound is below
    the last of the best documents so far can have a better one; only the others' postings are read.
    """
    terms = list(dict.fromkeys(terms))
    bounds, idf = block_bounds(blocks, terms, n, average)
    own = blocks.filter(F.col("term").isin(terms))
    bounds = cut(bounds)
    first = [r["block"] for r in bounds.orderBy(F.desc("bound"), "block").limit(limit).select("block").collect()]  # limit rows
    best = top(bm25_in_blocks(own.filter(F.col("block").isin(first)), idf, average), limit).collect()
    schema = bm25_in_blocks(own.limit(0), idf, average).schema
    known = values(blocks.sparkSession, best, schema)
    # rounded scores may be that much above a bound
    least = best[-1]["score"] - 1e-6 if len(best) == limit and limit else -math.inf
    rest = bounds.filter((F.col("bound") >= F.lit(least)) & ~F.col("block").isin(first)).select("block")
    return top(known.unionByName(bm25_in_blocks(own.join(rest, "block", "left_semi"), idf, average)), limit)


def top(scored: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The best rows; equal scores in order of key."""
    return scored.orderBy(F.desc("score"), F.col(key)).limit(limit)


def record(rows: DataFrame, ident: int, key: str = "__id") -> DataFrame:
    """The row of an id, which is a filter that reaches the scan; no row if there is none."""
    return rows.filter(F.col(key) == ident).limit(1)


def with_content(best: DataFrame, index: DataFrame) -> DataFrame:
    """Scored entries (id, score) with where they come from and what they say; best is as small as its limit."""
    return best.join(index.select("id", "source_table", "source_id", "source_field", "chunk_seq", "content"), "id")


def ranked(scored: DataFrame, prefetch: int, key: str = "id") -> DataFrame:
    """key and rank of the best rows. The window sees only these, where ranks are those among all."""
    best = top(scored.select(key, "score"), prefetch, key)
    return best.select(key, F.rank().over(Window.orderBy(F.desc("score"))).cast("long").alias("rank"))


def fuse(vectors: DataFrame, texts: DataFrame, *, limit: int, k: int, alpha: float, key: str = "id") -> DataFrame:
    """Reciprocal-rank fusion of two scored lists, each cut to three times the limit; a missing side counts 0."""
    v = ranked(vectors, 3 * limit, key).withColumnRenamed("rank", "v_rank")
    t = ranked(texts, 3 * limit, key).withColumnRenamed("rank", "t_rank")
    part = lambda weight, rank: F.coalesce(F.lit(weight) / (F.lit(float(k)) + F.col(rank)), F.lit(0.0))
    score = (part(float(alpha), "v_rank") + part(1.0 - alpha, "t_rank")) * F.lit(k + 1.0)
    return top(v.join(t, key, "full_outer").select(key, F.round(score, 6).alias("score")), limit, key)


def corpus_size(index: DataFrame) -> int:
    return index.agg(F.count_distinct(F.struct("source_table", "source_id"))).first()[0]
