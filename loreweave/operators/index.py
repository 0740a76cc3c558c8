"""The search index: chunks, hashes, tokens and cached vectors of text fields; and full-text statistics."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreweave.functions.text import chunk_text, content_hash, segment, tokens
from loreweave.shared import cut

Embedder = Callable[[list[str]], list[list[float]]]


def entries(nodes: DataFrame, table: str, fields: Sequence[str], *, size: int = 800, overlap: int = 100, id_col: str = "__id", carry: Sequence[str] = ()) -> DataFrame:
    """A row for each chunk of each non-empty text field; fields that aren't text have none. ``carry``: columns that go with them."""
    texts = [f for f in fields if dict(nodes.dtypes).get(f) == "string"]
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("source_field"), F.col(f).alias("text")) for f in texts])) if texts else None
    if pairs is None:
        empty = nodes.sparkSession.createDataFrame([], "source_table string, source_id long, source_field string, chunk_seq int, content string, content_hash string")
        return empty.select("*", *[F.lit(None).cast(nodes.schema[c].dataType).alias(c) for c in carry])
    with_ = F.struct(*[F.col(c) for c in carry]).alias("__carry") if carry else F.lit(None).alias("__carry")
    long = nodes.select(F.col(id_col).cast("long").alias("source_id"), with_, pairs.alias("p")).select("source_id", "__carry", "p.*").filter("text is not null and text <> ''")
    chunks = long.select(F.lit(table).alias("source_table"), "source_id", "source_field", "__carry", F.posexplode(chunk_text(F.col("text"), size, overlap)).alias("chunk_seq", "content"))
    return chunks.withColumn("content_hash", content_hash(F.col("content"))).select("source_table", "source_id", "source_field", "chunk_seq", "content", "content_hash", *[F.col("__carry").getField(c).alias(c) for c in carry])


def with_cache(rows: DataFrame, cache: DataFrame, *, compute_tokens: bool = True, words: Sequence[str] = ()) -> DataFrame:
    """Tokens and vectors of entries from the cache; missing tokens are computed, missing vectors stay null."""
    known = cache.select("content_hash", F.col("fts_content").alias("c_fts"), "vector")
    out = rows.join(known, "content_hash", "left")
    own = F.nullif("c_fts", F.lit(""))
    return out.withColumn("fts_content", F.coalesce(own, segment(F.col("content"), words)) if compute_tokens else own).drop("c_fts")


def merge_cache(cache: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """cache with new tokens and vectors by content_hash; what a new row lacks stays as it was."""
    cols = [c for c in ("fts_content", "vector") if c in new.columns]
    fresh = new.groupBy("content_hash").agg(*[F.first(c, ignorenulls=True).alias(f"n_{c}") for c in cols]).withColumn("n_", F.lit(True))
    joined = cache.join(fresh, "content_hash", "full_outer")
    pick = lambda c: F.coalesce(F.col(f"n_{c}"), F.col(c)) if c in cols else F.col(c)
    touched = lambda c: F.when(F.col("n_"), now).otherwise(F.col(c)).alias(c)
    return joined.select("content_hash", pick("fts_content").alias("fts_content"), pick("vector").alias("vector"), touched("last_used"), touched("created_at"))


def with_vectors(rows: DataFrame, new: DataFrame) -> DataFrame:
    """Rows, whose missing vectors come from new (content_hash, vector)."""
    found = new.select("content_hash", F.col("vector").alias("__new"))
    return rows.join(found, "content_hash", "left").withColumn("vector", F.coalesce("vector", "__new")).select(*rows.columns)


def renewed(held: DataFrame, ids: DataFrame | None, rows: DataFrame) -> DataFrame:
    """Entries of a node type after its nodes ``ids`` (__id; None: all) have changed: theirs are rows, the others stay."""
    kept = held.limit(0) if ids is None else held.join(ids.select(F.col("__id").alias("source_id")), "source_id", "left_anti").select(*held.columns)
    return kept.unionByName(rows)


def expire(cache: DataFrame, days: int, now: Column) -> DataFrame:
    return cache.filter(F.col("last_used") >= now - F.make_dt_interval(F.lit(days)))


def embed_missing(rows: DataFrame, embedder: Embedder, batch: int = 100, tries: int = 3, pause: float = 1.0) -> DataFrame:
    """content_hash and vector of distinct contents that have none.

    A batch that fails is tried again after ``pause`` seconds; after ``tries`` failures it gives null vectors.
    """
    todo = rows.filter("vector is null").select("content_hash", "content").dropDuplicates(["content_hash"])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for i in range(0, len(part), batch):
                p = part.iloc[i : i + batch]
                for left in reversed(range(tries)):
                    try:
                        vectors, error = embedder(p["content"].tolist()), None
                        break
                    except Exception as e:  # noqa: BLE001  a provider may fail in any way; the reason is kept in the row
                        vectors, error = None, repr(e)
                    if left:
                        time.sleep(pause)
                yield pd.DataFrame({"content_hash": p["content_hash"], "vector": vectors, "error": error})

    return todo.mapInPandas(run, "content_hash string, vector array<float>, error string")


def _posted(rows: DataFrame, keys: Sequence[str], words: Column) -> DataFrame:
    """keys, dl, term and tf: a row for each distinct word of each row's array ``words``.

    A row's words are sorted and counted where the row is: tf is the distance between the ends of two runs of equal
    words. So no exchange has a row for each word of the corpus, as a groupBy of rows and words would.
    """
    # generators of one row keep the optimizer from putting an array's expression in place of each of its uses
    rows = rows.select(*keys, F.explode(F.array(F.sort_array(words))).alias("t")).withColumn("dl", F.size("t")).filter("dl > 0")
    ends = F.filter(F.sequence(F.lit(1), F.col("dl")), lambda i: (i == F.col("dl")) | (F.get("t", i) != F.get("t", i - 1)))
    runs = F.transform("ends", lambda e, k: F.struct(F.get("t", e - 1).alias("term"), (e - F.coalesce(F.get("ends", k - 1), F.lit(0))).cast("long").alias("tf")))
    return rows.select(*keys, "dl", "t", F.explode(F.array(ends)).alias("ends")).select(*keys, "dl", F.inline(runs))


def word_counts(index: DataFrame) -> DataFrame:
    """term, tf and dl of each distinct word of each entry's stored tokens, without an exchange."""
    return _posted(index, [], _stored_tokens()).select("term", "tf", "dl")


def postings(index: DataFrame, text: str = "content") -> DataFrame:
    """id, term, tf and dl; written once per snapshot, it serves any query. Ids differ."""
    return _posted(index, ["id"], tokens(F.col(text))).select("id", "dl", "term", "tf")


def stored_postings(index: DataFrame) -> DataFrame:
    """Postings of the stored tokens, in order of term: a query reads the row groups that its terms are in. Ids differ.

    They are written once before they are put in order, which looks at its input twice, as every reader of the result would.
    """
    posts = _posted(index, ["source_table", "id"], _stored_tokens())
    return by_term(cut(posts.select("source_table", "id", F.col("dl").cast("long").alias("dl"), "term", "tf")))


def _stored_tokens() -> Column:
    return F.array_remove(F.split("fts_content", " "), "")


def by_term(posts: DataFrame) -> DataFrame:
    return posts.repartitionByRange("term", "id").sortWithinPartitions("term", "id")


def block_postings(posts: DataFrame, size: int = 1024) -> DataFrame:
    """Postings (id, term, tf, dl) in blocks: a row for each term and each range of ``size`` ids that has it.

    block is the range's first id, n its number of postings, max_tf and min_dl bound what any of them can score, and
    ``rows`` has them as offsets from block, frequencies and lengths, which compress well. Ranges are the same for all terms, so
    what a document can score is bounded by the sum over its block. A block is made in one task and has ``size`` postings at most.
    """
    return _blocks(_placed(posts, size)).repartitionByRange("term", "block").sortWithinPartitions("term", "block")


def stored_block_postings(index: DataFrame, size: int = 1024) -> DataFrame:
    """block_postings of the stored tokens, each partition in order of term. Ids differ.

    Entries are dealt to partitions by block, so an exchange has their texts and no row for each posting.
    """
    own = _placed(index.select("id", "fts_content"), size).select("block", "at", "fts_content").repartition("block")
    return _blocks(_posted(own, ["block", "at"], _stored_tokens())).sortWithinPartitions("term", "block")


def _placed(rows: DataFrame, size: int) -> DataFrame:
    return rows.withColumn("at", F.pmod("id", F.lit(size)).cast("int")).withColumn("block", F.col("id") - F.col("at"))


def _blocks(posts: DataFrame) -> DataFrame:
    one = F.struct("at", F.col("tf").cast("int").alias("tf"), F.col("dl").cast("int").alias("dl"))
    return posts.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max("tf").cast("int").alias("max_tf"), F.min("dl").cast("int").alias("min_dl"), F.sort_array(F.collect_list(one)).alias("rows"))


def stats(index: DataFrame) -> DataFrame:
    """For each source table: documents, chunks with tokens, and their tokens."""
    n = F.size(_stored_tokens()).cast("long")
    return index.groupBy("source_table").agg(F.count_distinct("source_id").alias("documents"), F.count("fts_content").alias("chunks"), F.coalesce(F.sum(F.when(F.col("fts_content").isNotNull(), n)), F.lit(0).cast("long")).alias("tokens"))


def stats_change(old: DataFrame, new: DataFrame) -> DataFrame:
    """What replacing the entries ``old`` by ``new`` adds to stats(), if all entries of a document are replaced together."""
    both = stats(new).unionByName(stats(old).select("source_table", *[(-F.col(c)).alias(c) for c in ("documents", "chunks", "tokens")]))
    return summed(both)


def summed(stats: DataFrame) -> DataFrame:
    return stats.groupBy("source_table").agg(*[F.sum(c).alias(c) for c in ("documents", "chunks", "tokens")])


def sketches(index: DataFrame) -> DataFrame:
    """For each source table, sketches that can be merged: of its documents, of its terms, and of its entries' numbers of
    tokens. They are made where the rows are; no exchange has a row for each word, as counting terms exactly would.
    """
    own = index.select("source_table", "source_id", _stored_tokens().alias("t"))
    sizes = own.groupBy("source_table").agg(F.hll_sketch_agg("source_id").alias("documents"), F.kll_sketch_agg_bigint(F.size("t").cast("long")).alias("tokens"))
    terms = own.select("source_table", F.explode("t").alias("term")).groupBy(F.col("source_table").alias("__of")).agg(F.hll_sketch_agg("term").alias("terms"))
    return sizes.join(terms, F.col("source_table").eqNullSafe(F.col("__of")), "left").select("source_table", "documents", "terms", "tokens")


def merged_sketches(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches of slices as one of each group, or of all."""
    return rows.groupBy(*by).agg(F.hll_union_agg("documents").alias("documents"), F.hll_union_agg("terms").alias("terms"), F.kll_merge_agg_bigint("tokens").alias("tokens"))


def estimates(rows: DataFrame, shares: Sequence[float] = (0.5, 0.9)) -> DataFrame:
    """What sketches tell: documents and terms, each about, and ``tokens``, the number that a share of entries has at most.

    Without entries that have tokens it is null. Counts are off by over 5 % (three times 1.6 %), and ranks of quantiles by over 2 %, in few of a hundred cases.
    """
    # a sketch of no entries with tokens has no quantiles
    told = F.when(F.kll_sketch_get_n_bigint("tokens") > 0, F.array(*[F.kll_sketch_get_quantile_bigint("tokens", F.lit(s)) for s in shares])).alias("tokens")
    zero = F.lit(0).cast("long")
    return rows.select(*[c for c in rows.columns if c not in ("documents", "terms", "tokens")], *[F.coalesce(F.hll_sketch_estimate(c), zero).alias(c) for c in ("documents", "terms")], told)
