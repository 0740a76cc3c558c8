"""Queries of the knowledge-base operators over the driver's tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.text import chunk_by_sentence, chunk_text, content_hash, segment, tokens
from loreweave.model import QUERY_LIMIT, RRF
from loreweave.operators import graph, index, joins, merge, sampling, search, sqlgate, vectors
from loreweave.plans.driver_sql import ORACLE_SQL
from loreweave.shared import cut, shared_folder, values
from loreweave.sources.files import Files
from loreweave.sources.store import Snapshots, dump, partition_counts, read_jsonl
from loreweave.streaming.bundles import latest_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TERMS = ["tion", "ingthe", "and", "eau"]


def _query(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
    QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
    return f


class Tables:
    """The driver's tables by name."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        """A table, whose schema is read once."""
        self.__dict__[name] = df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return df

    def named(self, names: str) -> dict[str, DataFrame]:
        return {n: getattr(self, n) for n in names.split()}

    @property
    def docs(self) -> DataFrame:
        return self.documents.withColumnRenamed("doc_id", "id")

    @property
    def vectors(self) -> DataFrame:
        return self.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")

    def kinds(self) -> list[graph.Kind]:
        """The tables as a graph of typed nodes."""

        def kind(name: str, rows: DataFrame, ident: str, a: str, a_id: str, b: str, b_id: str, repeats: bool = False) -> graph.Kind:
            return graph.Kind(name, a, b, rows.select(F.expr(ident).cast("long").alias("edge_id"), F.col(a_id).cast("long").alias("from_id"), F.col(b_id).cast("long").alias("to_id")), repeats)

        return [
            kind("placed", self.orders, "o_orderkey", "Customer", "o_custkey", "Order", "o_orderkey"),
            kind("contains", self.lineitem, "l_orderkey * 4294967296 + l_partkey", "Order", "l_orderkey", "Part", "l_partkey", True),
            kind("supplied_by", self.lineitem, "l_partkey * 4294967296 + l_suppkey", "Part", "l_partkey", "Supplier", "l_suppkey", True),
            kind("located_in", self.customer, "c_custkey", "Customer", "c_custkey", "Nation", "c_nationkey"),
            kind("based_in", self.supplier, "s_suppkey", "Supplier", "s_suppkey", "Nation", "s_nationkey"),
            kind("in_region", self.nation, "n_nationkey", "Nation", "n_nationkey", "Region", "n_regionkey"),
        ]

    def edges(self, distinct: bool = True) -> DataFrame:
        """The kinds as one table of edges; where repeats of an edge don't matter, they needn't be taken out."""
        return reduce(DataFrame.unionByName, [k.edges(distinct) for k in self.kinds()])

    def node(self, kind: str, ident: int) -> DataFrame:
        return values(self.spark, [(kind, ident)], "type string, id long")


@contextmanager
def dumped_to(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared one, removed afterwards."""
    folder = f"{shared_folder(spark)}/dump-{uuid.uuid4().hex}"
    try:
        yield folder
    finally:
        Files(spark).remove(folder)


def _best(scored: DataFrame, limit: int) -> DataFrame:
    return search.top(scored.select("id", "score"), limit)


def _query_vector(t: Tables):
    """The query is a stored vector; one row."""
    row = t.vectors.filter("id = 0").select("vector").first()
    return F.array(*[F.lit(float(x)) for x in row[0]]).cast("array<float>")


@_query
def fts_bm25(t: Tables) -> DataFrame:
    return _best(search.bm25_scores(t.docs, TERMS, "text"), 20)


@_query
def fts_bm25_filtered(t: Tables) -> DataFrame:
    return _best(search.bm25_scores(t.docs, TERMS, "text", F.col("lang") == "fr"), 20)


@_query
def vector_topk(t: Tables) -> DataFrame:
    return _best(search.vector_scores(t.vectors, _query_vector(t)), 15)


@_query
def vector_topk_filtered(t: Tables) -> DataFrame:
    return _best(search.vector_scores(t.vectors.filter("label = 3"), _query_vector(t)), 15)


def _hybrid(t: Tables, alpha: float, limit: int = 10) -> DataFrame:
    return search.fuse(search.vector_scores(t.vectors, _query_vector(t)), search.bm25_scores(t.docs, TERMS, "text"), limit=limit, k=10, alpha=alpha)


@_query
def hybrid_rrf(t: Tables) -> DataFrame:
    return _hybrid(t, 0.5)


@_query
def hybrid_rrf_alpha(t: Tables) -> DataFrame:
    return _hybrid(t, 0.8)


@_query
def rrf_auto_k(t: Tables) -> DataFrame:
    n = search.corpus_size(t.documents.select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("source_id")))
    return t.spark.createDataFrame([(n, RRF().of(n))], "documents long, rrf_k long")


@_query
def corpus_doc_count(t: Tables) -> DataFrame:
    chunks = index.entries(t.documents, "documents", ["text"], id_col="doc_id")
    return chunks.agg(F.count_distinct(F.struct("source_table", "source_id")).alias("documents"), F.count(F.lit(1)).alias("chunks"))


@_query
def chunk_documents(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(chunk_text(F.col("text"))).alias("chunk_seq", "content"))
    return rows.select("doc_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.length("content").cast("long").alias("n_chars"), content_hash(F.col("content")).alias("content_hash"))


@_query
def chunk_stats(t: Tables) -> DataFrame:
    rows = t.documents.select("lang", F.size(chunk_text(F.col("text"), 333, 50)).alias("n"))
    return rows.groupBy("lang").agg(F.sum("n").alias("chunks"), F.max("n").cast("long").alias("most"))


@_query
def chunk_sentences(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", F.posexplode(chunk_by_sentence(F.col("text"), 400)).alias("seq", "content"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunks"), F.max(F.length("content")).cast("long").alias("longest"))


@_query
def segment_text(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"), content_hash(segment(F.col("text"))).alias("segment_hash"))


@_query
def fts_term_stats(t: Tables) -> DataFrame:
    posts = index.postings(t.docs.select("id", F.col("text").alias("content")))
    return posts.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"), F.max("tf").alias("max_tf"))


@_query
def content_hash_dedupe(t: Tables) -> DataFrame:
    return t.documents.groupBy(content_hash(F.col("text")).alias("content_hash")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))


@_query
def cache_hit_join(t: Tables) -> DataFrame:
    rows = index.entries(t.documents, "documents", ["text"], id_col="doc_id")
    cached = index.entries(t.documents.filter("lang = 'en'"), "documents", ["text"], id_col="doc_id").select("content_hash").distinct()
    cache = cached.select("content_hash", F.lit("cached").alias("fts_content"), F.lit(None).cast("array<float>").alias("vector"))
    hit = index.with_cache(rows, cache, compute_tokens=False)
    return hit.groupBy("source_table").agg(F.count("fts_content").alias("hits"), F.count_if(F.col("fts_content").isNull()).alias("misses"))


@_query
def index_entries(t: Tables) -> DataFrame:
    rows = index.entries(t.part, "part", ["p_name", "p_type"], id_col="p_partkey")
    return rows.select("source_table", "source_id", "source_field", F.col("chunk_seq").cast("long").alias("chunk_seq"), "content", "content_hash", segment(F.col("content")).alias("fts_content"))


@_query
def node_upsert_merge(t: Tables) -> DataFrame:
    """Customers as nodes; orders bring each customer's last status, and one unknown customer."""
    old, new = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")
    current = t.customer.select((F.col("c_custkey") + 1).alias("__id"), old.alias("__created_at"), old.alias("__updated_at"), F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("status"))
    batch = merge.last_wins(t.orders.select(F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"), "o_orderdate", "o_orderkey"), ["key"], ["o_orderdate", "o_orderkey"])
    extra = t.spark.createDataFrame([(-5, "N")], "key long, status string")
    out = merge.upsert(current, batch.select("key", "status").unionByName(extra), ["key"], now=new)
    return out.select("__id", F.date_format("__created_at", "yyyy-MM-dd").alias("created"), F.date_format("__updated_at", "yyyy-MM-dd").alias("updated"), "key", "name", "status")


def _changed_orders(t: Tables, **limits: float) -> DataFrame:
    """Orders after three changes: finished ones get a new status and price, those of low priority go, and new ones come."""
    store = Snapshots(f"{shared_folder(t.spark)}/kb-changes-{uuid.uuid4().hex}", t.spark, delta_from=0, **limits)
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    store.publish({"orders": t.orders.select(*columns)})
    finished = t.orders.filter("o_orderstatus = 'F'").withColumn("o_orderstatus", F.lit("X")).withColumn("o_totalprice", F.col("o_totalprice") * 2).select(*columns)
    low = t.orders.filter("o_orderpriority = '5-LOW'").select("o_orderkey")
    new = t.customer.select((-F.col("c_custkey") - 1).alias("o_orderkey"), F.col("c_custkey").alias("o_custkey"), F.lit("N").alias("o_orderstatus"), F.col("c_acctbal").alias("o_totalprice"))
    for rows, gone in ((finished, low.limit(0)), (finished.limit(0), low), (new, low.limit(0))):
        with store.version() as version:
            version.change("orders", rows, "o_orderkey", gone)
    return store.read(t.spark, "orders", t.orders.select(*columns).schema)


@_query
def table_changes_merged(t: Tables) -> DataFrame:
    """Changes beside their table, merged as it is read."""
    return _changed_orders(t, most_deltas=10, most_share=1e9)


@_query
def table_changes_rewritten(t: Tables) -> DataFrame:
    """Each change makes the table anew from what it was and the changes."""
    return _changed_orders(t, most_deltas=1, most_share=1e9)


@_query
def edge_upsert_dedupe(t: Tables) -> DataFrame:
    order = ["l_shipdate", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
    rows = merge.last_wins(t.lineitem, ["l_orderkey", "l_partkey"], order)
    return rows.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity"), "l_returnflag")


@_query
def edge_ref_violations(t: Tables) -> DataFrame:
    nodes = t.orders.filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("__id"))
    edges = t.lineitem.select(F.col("l_orderkey").alias("__from_id"))
    return merge.violations(edges, nodes, "__from_id").groupBy("__from_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def node_delete_cascade(t: Tables) -> DataFrame:
    gone = t.customer.filter("c_acctbal < 0").select(F.col("c_custkey").alias("__id"))
    edges = t.orders.select(F.col("o_custkey").alias("__from_id"), F.col("o_orderkey").alias("__to_id"))
    return merge.cascade(edges, gone, source=True, target=False).groupBy("__from_id").agg(F.count(F.lit(1)).alias("n"), F.max("__to_id").alias("last_order"))


@_query
def identity_resolution(t: Tables) -> DataFrame:
    nodes = t.nation.select(F.col("n_nationkey").cast("long").alias("__id"), "n_name")
    batch = t.customer.select("c_custkey", F.when(F.col("c_nationkey") < 20, F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string"))).otherwise("nowhere").alias("src"))
    return merge.resolve(batch, nodes, {"n_name": "src"}, "__from_id").groupBy("src", "__from_id").agg(F.count(F.lit(1)).alias("n"))


@_query
def source_record(t: Tables) -> DataFrame:
    return search.record(t.orders, 7, "o_orderkey").select("o_orderkey", "o_custkey", "o_orderstatus")


@_query
def dump_partition_counts(t: Tables) -> DataFrame:
    return partition_counts(t.events.withColumnRenamed("ts", "__created_at"), 100)


@_query
def dump_by_date(t: Tables) -> DataFrame:
    """Events dumped in a folder for each day and read again: what each folder has."""
    rows = t.events.select(F.col("event_id").alias("__id"), F.col("ts").cast("timestamp_ntz").alias("__created_at"), "event_type", "value")
    with dumped_to(t.spark) as folder:
        dump(rows, folder, by_date=True, rows_per_file=100)
        read = read_jsonl(t.spark, folder, rows.schema).withColumn("dt", F.regexp_extract("_metadata.file_path", "dt=([^/]+)/", 1))
        return cut(read.groupBy("dt", "event_type").agg(F.count(F.lit(1)).alias("n"), F.min("__id").alias("first_id"), F.max("__created_at").alias("last_at"), F.round(F.sum("value"), 4).alias("total")))


@_query
def cache_expiry(t: Tables) -> DataFrame:
    now = F.lit("2024-01-31").cast("timestamp_ntz")
    rows = t.events.select(F.col("ts").cast("timestamp_ntz").alias("last_used"), "event_type")
    return index.expire(rows, 7, now).groupBy("event_type").agg(F.count(F.lit(1)).alias("kept"))


def _steps(t: Tables, kind: str, rows: DataFrame, key: str, **options) -> DataFrame:
    seeds = rows.select(F.lit(kind).alias("type"), F.col(key).cast("long").alias("id"))
    return graph.neighbors(t.kinds(), seeds, **options)


@_query
def neighbors_out(t: Tables) -> DataFrame:
    return _steps(t, "Customer", t.customer, "c_custkey", direction="out").select("src_id", "edge_type", "edge_id", "dst_type", "dst_id")


@_query
def neighbors_in(t: Tables) -> DataFrame:
    return _steps(t, "Part", t.part, "p_partkey", direction="in", limit=10).select("src_id", "edge_type", "edge_id", "dst_type", "dst_id")


@_query
def neighbors_both(t: Tables) -> DataFrame:
    steps = graph.merged_neighbors(_steps(t, "Supplier", t.supplier, "s_suppkey", limit=50))
    return steps.select("src_id", "dst_type", "dst_id", "edge_type", F.size("hits").cast("long").alias("n_edges"), F.array_join("directions", ",").alias("directions"))


@_query
def neighbors_by_edge_type(t: Tables) -> DataFrame:
    steps = _steps(t, "Nation", t.nation, "n_nationkey", limit=40, edge_types=["located_in", "in_region"])
    return steps.groupBy("src_id", "edge_type", "direction").agg(F.count(F.lit(1)).alias("n"), F.max("edge_id").alias("last_edge"))


@_query
def traverse_nodes(t: Tables) -> DataFrame:
    found = graph.traverse_nodes(t.edges(), t.node("Region", 0), direction="in", max_depth=3)
    return found.select("type", "id", F.col("min_depth").cast("long").alias("min_depth"), "paths_count")


def _path_rows(df: DataFrame) -> DataFrame:
    return df.select(F.array_join("nodes", ">").alias("nodes"), F.array_join("edges", ">").alias("edges"), F.col("depth").cast("long").alias("depth"))


@_query
def traverse_paths(t: Tables) -> DataFrame:
    return _path_rows(graph.paths(t.edges(distinct=False), t.node("Customer", 7), direction="out", max_depth=3))


@_query
def find_paths(t: Tables) -> DataFrame:
    return _path_rows(graph.paths(t.edges(distinct=False), t.node("Customer", 7), direction="both", max_depth=3, to=t.node("Supplier", 3), limit=10))


@_query
def extract_subgraph_nodes(t: Tables) -> DataFrame:
    nodes, _ = graph.subgraph(t.edges(), t.node("Order", 7), max_depth=2)
    return nodes.select("type", "id", F.col("min_depth").cast("long").alias("min_depth"))


@_query
def extract_subgraph_edges(t: Tables) -> DataFrame:
    _, edges = graph.subgraph(t.edges(), t.node("Order", 7), max_depth=2)
    return edges.select("edge_type", "edge_id", "from_type", "from_id", "to_type", "to_id")


@_query
def graph_search_context(t: Tables) -> DataFrame:
    """Hybrid hits, and the other documents of their sources, ten at most of each."""
    hits = _hybrid(t, 0.5, 5)
    edges = t.documents.select(F.lit("from_source").alias("edge_type"), F.col("doc_id").alias("edge_id"), F.lit("Document").alias("from_type"), F.col("doc_id").alias("from_id"), F.lit("Source").alias("to_type"), F.substring("source", 4, 9).cast("long").alias("to_id"))
    found = graph.context(edges, hits.select(F.lit("Document").alias("type"), "id"), max_depth=2, limit=10).filter("type = 'Document'")
    return found.join(hits.withColumnRenamed("id", "seed_id"), "seed_id").select(F.col("seed_id").alias("seed"), "score", F.col("from_id").alias("source"), F.col("id").alias("node"))


@_query
def graph_context(t: Tables) -> DataFrame:
    """Around every supplier and every nation, the nodes within two steps, five at most of each edge type and node."""
    seeds = t.supplier.select(F.lit("Supplier").alias("type"), F.col("s_suppkey").alias("id")).unionByName(t.nation.select(F.lit("Nation").alias("type"), F.col("n_nationkey").cast("long").alias("id")))
    found = graph.context(t.kinds(), seeds, max_depth=2, limit=5)
    return found.select("seed_type", "seed_id", F.col("depth").cast("long").alias("depth"), "type", "id", "edge_type", "edge_id", "direction", "from_type", "from_id")


def _sql(name: str, tables: str, text: str, whole: bool = False) -> None:
    """whole: without the gate's cap on rows, which is for interactive use."""
    QUERIES[name] = lambda spark, sf_dir: sqlgate.gated_sql(spark, text, Tables(spark, sf_dir).named(tables), cap=None if whole else QUERY_LIMIT)


_sql("sql_filter_order", "part", "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40 ORDER BY p_size DESC, p_partkey LIMIT 50")
_sql("sql_group_agg", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus")
_sql("sql_join3", "customer orders nation", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
_sql("sql_window", "orders", "SELECT o_custkey, o_orderkey, CAST(rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders", whole=True)
_sql("sql_setops", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3")
_sql("sql_rollup", "part", "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)", whole=True)
_sql("sql_cube", "orders", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_sql("sql_semi_anti", "customer orders", "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
_sql("sql_json_props", "events", "SELECT event_type, get_json_object(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL", whole=True)
_sql("sql_date_bucket", "events", "SELECT date_format(date_trunc('DAY', ts), 'yyyy-MM-dd') AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2", whole=True)
_sql("sql_recursive", "nation", "WITH RECURSIVE up(k, d) AS (SELECT 0, 0 UNION ALL SELECT k + 1, d + 1 FROM up WHERE d < 24) SELECT n_name, d FROM up JOIN nation ON n_nationkey = k")
_sql("sql_full_outer", "nation region", "SELECT r_name, n_name FROM region FULL OUTER JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0")


_sql("sql_auto_limit", "part", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey")
_sql("sql_pivot", "orders", "SELECT * FROM (SELECT o_orderpriority, o_orderstatus, o_orderkey FROM orders) PIVOT (count(o_orderkey) AS n FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))")
_sql("sql_unpivot", "part", "SELECT p_partkey, k, v FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS size, p_retailprice AS price FROM part) UNPIVOT (v FOR k IN (size, price))", whole=True)
_sql("sql_lateral", "nation customer", "SELECT n_name, c_custkey, c_acctbal FROM nation, LATERAL (SELECT c_custkey, c_acctbal FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal > 0) c", whole=True)
_sql("sql_frame_rows", "events", "SELECT event_id, round(sum(value) OVER w, 6) AS v3, count(*) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)", whole=True)
_sql("sql_frame_interval", "events", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '1' DAY PRECEDING AND CURRENT ROW) AS n_day FROM events", whole=True)
_sql("sql_qualify_latest", "orders", "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS r FROM orders) WHERE r = 1", whole=True)
_sql("sql_setops_all", "customer supplier nation", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation", whole=True)
_sql("sql_union_all", "customer supplier", "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k")
_sql("sql_grouping_sets", "part", "SELECT p_brand, p_size, grouping(p_brand) AS no_brand, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())", whole=True)
_sql("sql_agg_filter", "lineitem", "SELECT l_returnflag, count(*) FILTER (WHERE l_discount > 0.05) AS cheap, count(DISTINCT l_suppkey) FILTER (WHERE l_quantity > 25) AS suppliers, median(l_quantity) AS mid, max_by(l_orderkey, struct(l_extendedprice, l_orderkey)) AS dearest FROM lineitem GROUP BY l_returnflag")
_sql("sql_theta_join", "nation region", "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey < r_regionkey AND n_nationkey > r_regionkey * 3")
_sql("sql_anti_join", "customer orders", "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000", whole=True)
_sql("sql_arrays", "documents", "SELECT doc_id, CAST(size(filter(w, x -> length(x) > 5)) AS BIGINT) AS long_words, aggregate(transform(w, x -> CAST(length(x) AS BIGINT)), 0L, (a, x) -> a + x) AS letters, array_max(w) AS last_word FROM (SELECT doc_id, split(text, ' ') AS w FROM documents)", whole=True)
_sql("sql_strings", "part", "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*') AS masked, upper(substring(p_name, 1, 3)) AS head, p_name ILIKE '%A%' AS has_a, lpad(CAST(p_size AS STRING), 4, '0') AS size4, split_part(p_type, ' ', 1) AS kind FROM part", whole=True)
_sql("sql_star_except", "part", "SELECT * EXCEPT (p_retailprice), try_cast(p_name AS INT) AS n, CAST(p_size AS STRING) || 'x' AS size_x FROM part", whole=True)
_sql("sql_sample", "part", "SELECT count(*) AS n FROM part TABLESAMPLE (100 PERCENT)")


def _stored(t: Tables) -> DataFrame:
    """Documents as entries whose tokens are stored."""
    return cut(t.documents.select(F.lit("documents").alias("source_table"), F.col("doc_id").alias("id"), F.col("doc_id").alias("source_id"), segment(F.col("text")).alias("fts_content")))


@_query
def fts_postings(t: Tables) -> DataFrame:
    """BM25 from stored postings and statistics, as the engine searches."""
    rows = _stored(t)
    n, words = index.stats(rows).agg(F.sum("chunks"), F.sum("tokens")).first()
    return _best(search.bm25_postings(index.stored_postings(rows), TERMS, n or 0, words / n if words else 1.0), 20)


@_query
def interval_overlaps(t: Tables) -> DataFrame:
    """Of each user and kind of event, how many overlap with the user's errors, which last minutes where others last seconds."""
    began = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', CAST(ts AS TIMESTAMP_NTZ))")
    ends = lambda micros: began + F.round(F.col("value") * micros).cast("long")
    errors = t.events.filter("event_type = 'error'").select("user_id", began.alias("error_from"), ends(60_000_000).alias("error_to"))
    others = t.events.filter("event_type <> 'error'").select("user_id", "event_type", began.alias("event_from"), ends(1_000_000).alias("event_to"))
    found = joins.interval_join(errors, others, ["user_id"], ("error_from", "error_to"), ("event_from", "event_to"))
    return found.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.least("error_to", "event_to") - F.greatest("error_from", "event_from")).alias("micros"))


@_query
def fts_block_max(t: Tables) -> DataFrame:
    """The same from postings in blocks, of which only those are read that may have one of the best."""
    rows = _stored(t)
    n, words = index.stats(rows).agg(F.sum("chunks"), F.sum("tokens")).first()
    blocks = cut(index.stored_block_postings(rows, 64))
    return search.bm25_blocks(blocks, TERMS, n or 0, words / n if words else 1.0, 20)


@_query
def vector_clusters(t: Tables) -> DataFrame:
    """The best vectors from clusters, of which only those rows are scored that may be among them."""
    query = t.vectors.filter("id = 0").select("vector").first()[0]
    return vectors.nearest(vectors.clustered(t.vectors, len(query)), query, 15)


@_query
def vector_clusters_filtered(t: Tables) -> DataFrame:
    query = t.vectors.filter("id = 0").select("vector").first()[0]
    return vectors.nearest(vectors.clustered(t.vectors, len(query)), query, 15, keep=F.col("label") == 3)


@_query
def sample_stratified(t: Tables) -> DataFrame:
    """20 orders of each priority, from the merged sketches of orders by status."""
    orders = t.orders.select("o_orderkey", "o_orderpriority", "o_orderstatus")
    parts = [orders.filter("o_orderstatus = 'F'"), orders.filter("o_orderstatus is distinct from 'F'")]
    sketch = sampling.merged([sampling.bottom(p, 20, "o_orderkey", strata=["o_orderpriority"]) for p in parts], 20, strata=["o_orderpriority"])
    return sampling.sample(sketch, 20, strata=["o_orderpriority"]).select("o_orderkey", "o_orderpriority", F.round("chance", 9).alias("chance"))


@_query
def sample_weighted(t: Tables) -> DataFrame:
    """25 orders of each status, the dearer the likelier."""
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    sketch = sampling.bottom(orders, 25, "o_orderkey", strata=["o_orderstatus"], weight="o_totalprice", salt="w")
    return sampling.sample(sketch, 25, strata=["o_orderstatus"], weight="o_totalprice").select("o_orderkey", "o_orderstatus", F.round("chance", 6).alias("chance"))


@_query
def stream_latest(t: Tables) -> DataFrame:
    """Each user's last event, from a stream of files of events in no order of time, four in a batch."""
    root = f"{shared_folder(t.spark)}/kb-stream-{uuid.uuid4().hex}"
    rows = t.events.select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "event_type", "value")
    rows.repartition(16, "event_id").write.parquet(f"{root}/in")
    store = Snapshots(f"{root}/kb", t.spark)
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 4).parquet(f"{root}/in")
    latest_stream(stream, store, "last_events", "user_id", order="ts", checkpoint=f"{root}/checkpoint").awaitTermination()
    return store.read(t.spark, "last_events", rows.schema).select("user_id", "event_id", "event_type", "value")


@_query
def index_sketches(t: Tables) -> DataFrame:
    """Of each language and of all, exact numbers beside whether those of merged sketches are within their bounds."""
    rows = cut(t.documents.select(F.col("lang").alias("source_table"), F.col("doc_id").alias("source_id"), segment(F.col("text")).alias("fts_content")))
    slices = cut(index.sketches(rows))
    told = index.estimates(index.merged_sketches(slices, ["source_table"])).unionByName(index.estimates(index.merged_sketches(slices)).select(F.lit("all").alias("source_table"), "*"))
    split = rows.withColumn("t", F.array_remove(F.split("fts_content", " "), ""))
    both = F.explode(F.array("source_table", F.lit("all"))).alias("source_table")
    groups = split.select(both, "source_id", F.size("t").alias("size"))
    exact = groups.groupBy("source_table").agg(F.count_distinct("source_id").alias("documents"))
    # a word counts once for its language before it counts for all
    terms = split.select("source_table", F.explode("t").alias("term")).distinct().select(both, "term").groupBy("source_table").agg(F.count_distinct("term").alias("terms"))
    half = groups.join(F.broadcast(told.select("source_table", F.col("tokens")[0].alias("half"))), "source_table").groupBy("source_table")  # a row for each language
    ranks = half.agg(F.avg((F.col("size") < F.col("half")).cast("double")).alias("below"), F.avg((F.col("size") <= F.col("half")).cast("double")).alias("upto"))
    near = lambda c: F.abs(F.col(f"told.{c}") - F.col(f"exact.{c}")) <= 0.05 * F.col(f"exact.{c}")
    exact = exact.join(terms, "source_table").join(ranks, "source_table").alias("exact")
    found = exact.join(told.alias("told"), F.col("exact.source_table").eqNullSafe(F.col("told.source_table")))
    return found.select("exact.source_table", "exact.documents", "exact.terms", near("documents").alias("documents_near"), near("terms").alias("terms_near"), ((F.col("below") <= 0.52) & (F.col("upto") >= 0.48)).alias("half_near"))


@_query
def index_slice_stats(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("source_table"), F.col("doc_id").alias("source_id"), segment(F.col("text")).alias("fts_content"))
    return index.stats(rows)


@_query
def index_incremental(t: Tables) -> DataFrame:
    """Entries of all parts, where those of some have changed: theirs are made anew, the others stay."""
    held = index.entries(t.part, "part", ["p_name"], id_col="p_partkey")
    changed = t.part.filter("p_size > 40").withColumn("p_name", F.concat("p_name", F.lit(" renewed")))
    rows = index.entries(changed, "part", ["p_name"], id_col="p_partkey")
    return index.renewed(held, changed.select(F.col("p_partkey").alias("__id")), rows).select("source_id", "content", "content_hash")


@_query
def sql_asof(t: Tables) -> DataFrame:
    """For every order, the last earlier event's time."""
    o = t.orders.select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("at"), (F.col("o_custkey") % 100).alias("k"))
    e = t.events.select(F.col("ts").cast("timestamp").alias("at"), F.col("ts").cast("timestamp").alias("last"), (F.col("user_id") % 100).alias("k"))
    return joins.asof_join(o, e, ["k"], "at", ["last"]).select("o_orderkey", F.date_format("last", "yyyy-MM-dd HH:mm:ss").alias("last_event"))


@_query
def node_delete(t: Tables) -> DataFrame:
    """Customers without those that a batch of keys names, one of which is unknown and many repeated."""
    keys = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")).unionByName(t.spark.createDataFrame([(-7,)], "c_custkey long"))
    return merge.delete(t.customer, keys, ["c_custkey"]).select("c_custkey", "c_name")


@_query
def edge_delete(t: Tables) -> DataFrame:
    """Edges without those whose ends a batch names."""
    edges = t.lineitem.select(F.col("l_orderkey").alias("__from_id"), F.col("l_partkey").alias("__to_id")).distinct()
    batch = t.lineitem.filter("l_quantity > 25").select(F.col("l_orderkey").alias("__from_id"), F.col("l_partkey").alias("__to_id"))
    return merge.delete(edges, batch, ["__from_id", "__to_id"]).groupBy("__from_id").agg(F.count(F.lit(1)).alias("n"), F.max("__to_id").alias("last_part"))


@_query
def load_jsonl(t: Tables) -> DataFrame:
    """Rows dumped as JSON lines, read again and merged by key into a table: for each customer, the last counts."""
    now = F.lit("2030-01-01").cast("timestamp_ntz")
    at = F.col("o_orderdate").cast("timestamp_ntz")
    rows = t.orders.select(F.col("o_orderkey").alias("__id"), at.alias("__created_at"), at.alias("__updated_at"), F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("status"))
    with dumped_to(t.spark) as folder:
        dump(rows, folder, by_date=False, rows_per_file=500)
        current = t.customer.select(F.col("c_custkey").alias("__id"), now.alias("__created_at"), now.alias("__updated_at"), F.col("c_custkey").alias("key"), F.lit(None).cast("string").alias("status"))
        merged = cut(merge.loaded(current, read_jsonl(t.spark, folder, rows.schema), ["key"], now))
    return merged.select("__id", "key", "status")


@_query
def vector_write_back(t: Tables) -> DataFrame:
    """Entries, whose missing vectors come from newly embedded contents."""
    rows = t.vectors.select(F.col("id").cast("string").alias("content_hash"), F.when(F.col("label") % 2 == 0, F.col("vector")).alias("vector"))
    new = t.vectors.filter("label % 3 <> 0").select(F.col("id").cast("string").alias("content_hash"), F.transform("vector", lambda x: -x).alias("vector"))
    return index.with_vectors(rows, new).select("content_hash", F.round(F.col("vector")[0].cast("double"), 5).alias("first"))


@_query
def cache_upsert(t: Tables) -> DataFrame:
    """New tokens of some contents into a cache; what a new row lacks stays, and only touched entries get the time."""
    then, now = F.lit("2024-01-01").cast("timestamp_ntz"), F.lit("2024-02-01").cast("timestamp_ntz")
    hashed = t.documents.select("doc_id", "lang", content_hash(F.col("text")).alias("content_hash"))
    none = F.lit(None).cast("array<float>").alias("vector")
    cache = hashed.filter("lang = 'en'").select("content_hash").distinct().select("content_hash", F.lit("old").alias("fts_content"), none, then.alias("last_used"), then.alias("created_at"))
    new = hashed.filter("doc_id % 3 <> 0").select("content_hash", F.when(F.col("doc_id") % 3 == 1, F.lit("new")).alias("fts_content"))
    out = index.merge_cache(cache, new, now)
    return out.select("content_hash", "fts_content", F.date_format("last_used", "yyyy-MM-dd").alias("last_used"))


def _part_cache(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Entries of part names, and a cache that has the tokens of some and no vectors."""
    rows = index.entries(t.part, "part", ["p_name"], id_col="p_partkey")
    cache = t.part.filter("p_size > 25 and p_name <> ''").select(content_hash(F.col("p_name")).alias("content_hash")).distinct()
    return rows, cache.select("content_hash", F.lit("cached").alias("fts_content"), F.lit(None).cast("array<float>").alias("vector"))


@_query
def index_with_cache(t: Tables) -> DataFrame:
    """Tokens from the cache, or computed."""
    return index.with_cache(*_part_cache(t)).select("source_id", "fts_content")


@_query
def index_from_cache(t: Tables) -> DataFrame:
    """Tokens from the cache alone."""
    return index.with_cache(*_part_cache(t), compute_tokens=False).select("source_id", "fts_content")


def letter_counts(texts: list[str]) -> list[list[float]]:
    """An embedder whose vectors SQL can say: characters, and letters a."""
    return [[float(len(t)), float(t.count("a"))] for t in texts]


@_query
def embed_contents(t: Tables) -> DataFrame:
    """Each distinct content that has no vector is embedded once."""
    rows = index.entries(t.part, "part", ["p_name", "p_type"], id_col="p_partkey").withColumn("vector", F.lit(None).cast("array<float>"))
    return index.embed_missing(rows, letter_counts).select("content_hash", F.col("vector")[0].cast("long").alias("chars"), F.col("vector")[1].cast("long").alias("letters_a"))


@_query
def search_content(t: Tables) -> DataFrame:
    """The best texts joined back to what they say."""
    held = t.documents.select(F.col("doc_id").alias("id"), F.lit("documents").alias("source_table"), F.col("doc_id").alias("source_id"), F.lit("text").alias("source_field"), F.lit(0).alias("chunk_seq"), F.col("text").alias("content"))
    best = search.with_content(_best(search.bm25_scores(t.docs, TERMS, "text"), 20), held)
    return best.select("source_table", "source_id", "score", content_hash(F.col("content")).alias("content_hash"))


__all__ = ["ORACLE_SQL", "QUERIES"]
