"""DuckDB SQL for the queries over the driver's tables."""

from __future__ import annotations

ORACLE_SQL: dict[str, str] = {}

_TERMS = "'tion', 'ingthe', 'and', 'eau'"
_BM25 = f"""
docs AS (SELECT doc_id AS id, lang, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM docs),
tf AS (SELECT id, lang, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf FROM docs, (SELECT unnest([{_TERMS}]) AS term)),
df AS (SELECT term, count(*) AS df FROM tf WHERE tf > 0 GROUP BY term),
bm AS (
  SELECT id, lang, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1.0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / average))), 6) AS score
  FROM tf JOIN df USING (term), stats WHERE tf > 0 GROUP BY id, lang
)"""
_COSINE = """
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0),
vec AS (SELECT vec_id AS id, label, round(list_cosine_similarity(embedding::DOUBLE[], v), 6) AS score FROM embeddings, q)"""


def _hybrid(alpha: float, limit: int = 10) -> str:
    return f"""
v AS (SELECT id, rank() OVER (ORDER BY score DESC) AS r FROM (SELECT id, score FROM vec ORDER BY score DESC, id LIMIT {3 * limit})),
f AS (SELECT id, rank() OVER (ORDER BY score DESC) AS r FROM (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT {3 * limit})),
hybrid AS (
  SELECT id, round((coalesce({alpha} / (10 + v.r), 0) + coalesce({1 - alpha} / (10 + f.r), 0)) * 11, 6) AS score
  FROM v FULL OUTER JOIN f USING (id) ORDER BY score DESC, id LIMIT {limit}
)"""


ORACLE_SQL["fts_bm25"] = f"WITH {_BM25} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20"
ORACLE_SQL["fts_bm25_filtered"] = f"WITH {_BM25} SELECT id, score FROM bm WHERE lang = 'fr' ORDER BY score DESC, id LIMIT 20"
ORACLE_SQL["vector_topk"] = f"WITH {_COSINE} SELECT id, score FROM vec ORDER BY score DESC, id LIMIT 15"
ORACLE_SQL["vector_topk_filtered"] = f"WITH {_COSINE} SELECT id, score FROM vec WHERE label = 3 ORDER BY score DESC, id LIMIT 15"
ORACLE_SQL["hybrid_rrf"] = f"WITH {_BM25}, {_COSINE}, {_hybrid(0.5)} SELECT id, score FROM hybrid"
ORACLE_SQL["hybrid_rrf_alpha"] = f"WITH {_BM25}, {_COSINE}, {_hybrid(0.8)} SELECT id, score FROM hybrid"
ORACLE_SQL["rrf_auto_k"] = "SELECT count(DISTINCT doc_id) AS documents, (CASE WHEN count(DISTINCT doc_id) <= 10000 THEN 10 WHEN count(DISTINCT doc_id) <= 100000 THEN 20 WHEN count(DISTINCT doc_id) <= 1000000 THEN 40 ELSE 60 END)::BIGINT AS rrf_k FROM documents"


def chunks_sql(size: int, overlap: int, table: str = "documents") -> str:
    """Common table expressions that end in chunks (doc_id, lang, chunk_seq, content) of a table."""
    step, half = size - overlap, size // 2
    return f"""
base AS (SELECT doc_id, lang, text, length(text) AS n FROM {table} WHERE text <> ''),
starts AS (SELECT *, unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE n END, {step})) AS s FROM base),
wins AS (SELECT *, CASE WHEN n <= {size} THEN text ELSE substring(text, s + 1, {size}) END AS w FROM starts),
marked AS (SELECT *, sum(CASE WHEN n - s >= {half} OR s = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM wins),
joined AS (SELECT doc_id, any_value(lang) AS lang, any_value(n) AS n, g, string_agg(w, '' ORDER BY s) AS c FROM marked GROUP BY doc_id, g),
chunks AS (
  SELECT doc_id, lang, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS chunk_seq, content
  FROM (SELECT doc_id, lang, g, CASE WHEN n <= {size} THEN c ELSE regexp_replace(c, '^\\s+|\\s+$', '', 'g') END AS content FROM joined) WHERE content <> ''
)"""


ORACLE_SQL["corpus_doc_count"] = f"WITH {chunks_sql(800, 100)} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM chunks"
ORACLE_SQL["chunk_documents"] = f"WITH {chunks_sql(800, 100)} SELECT doc_id, chunk_seq, length(content) AS n_chars, md5(content) AS content_hash FROM chunks"
ORACLE_SQL["chunk_stats"] = f"WITH {chunks_sql(333, 50)} SELECT lang, sum(k)::BIGINT AS chunks, max(k) AS most FROM (SELECT lang, doc_id, count(*) AS k FROM chunks GROUP BY ALL) GROUP BY lang"
ORACLE_SQL["segment_text"] = "SELECT doc_id, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS segment_hash FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents)"
ORACLE_SQL["fts_term_stats"] = "SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf, max(tf) AS max_tf FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS term FROM documents) GROUP BY ALL) GROUP BY term"
ORACLE_SQL["content_hash_dedupe"] = "SELECT md5(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1"
ORACLE_SQL["cache_hit_join"] = f"WITH {chunks_sql(800, 100)}, en AS (SELECT DISTINCT md5(content) AS h FROM chunks WHERE lang = 'en') SELECT 'documents' AS source_table, count(h) AS hits, count(*) - count(h) AS misses FROM chunks LEFT JOIN en ON h = md5(content)"
ORACLE_SQL["index_entries"] = """
SELECT 'part' AS source_table, p_partkey AS source_id, source_field, 0::BIGINT AS chunk_seq, content, md5(content) AS content_hash, array_to_string(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+'), ' ') AS fts_content
FROM (SELECT p_partkey, 'p_name' AS source_field, p_name AS content FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part) WHERE content <> ''
"""
ORACLE_SQL["node_upsert_merge"] = """
WITH last AS (SELECT o_custkey AS key, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1),
merged AS (SELECT c_custkey + 1 AS id, coalesce(c_custkey, key) AS key, c_name AS name, status, c_custkey IS NULL AS is_new, key IS NOT NULL AS touched FROM customer FULL OUTER JOIN (SELECT * FROM last UNION ALL SELECT -5, 'N') ON key = c_custkey)
SELECT coalesce(id, (SELECT max(c_custkey) + 1 FROM customer) + row_number() OVER (PARTITION BY is_new ORDER BY key)) AS __id, CASE WHEN is_new THEN '2024-02-01' ELSE '2024-01-01' END AS created, CASE WHEN touched THEN '2024-02-01' ELSE '2024-01-01' END AS updated, key, name, status FROM merged
"""
ORACLE_SQL["edge_upsert_dedupe"] = """
SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_returnflag FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC, l_discount DESC, l_tax DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM lineitem
) WHERE rn = 1
"""
ORACLE_SQL["edge_ref_violations"] = "SELECT l_orderkey AS __from_id, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY 1"
ORACLE_SQL["node_delete_cascade"] = "SELECT o_custkey AS __from_id, count(*) AS n, max(o_orderkey) AS last_order FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1"
ORACLE_SQL["identity_resolution"] = "SELECT src, n_nationkey::BIGINT AS __from_id, count(*) AS n FROM (SELECT CASE WHEN c_nationkey < 20 THEN 'NATION_' || c_nationkey ELSE 'nowhere' END AS src FROM customer) LEFT JOIN nation ON n_name = src GROUP BY 1, 2"
ORACLE_SQL["source_record"] = "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 7"
ORACLE_SQL["dump_partition_counts"] = "SELECT strftime(ts, '%Y%m%d') AS dt, count(*) AS n_rows, ceil(count(*) / 100.0)::BIGINT AS n_files FROM events GROUP BY 1"
ORACLE_SQL["cache_expiry"] = "SELECT event_type, count(*) AS kept FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 7 DAY GROUP BY 1"

_EDGES = """
edges AS (
  SELECT 'placed' AS edge_type, o_orderkey AS edge_id, 'Customer' AS from_type, o_custkey AS from_id, 'Order' AS to_type, o_orderkey AS to_id FROM orders
  UNION ALL SELECT DISTINCT 'contains', l_orderkey * 4294967296 + l_partkey, 'Order', l_orderkey, 'Part', l_partkey FROM lineitem
  UNION ALL SELECT DISTINCT 'supplied_by', l_partkey * 4294967296 + l_suppkey, 'Part', l_partkey, 'Supplier', l_suppkey FROM lineitem
  UNION ALL SELECT 'located_in', c_custkey, 'Customer', c_custkey, 'Nation', c_nationkey FROM customer
  UNION ALL SELECT 'based_in', s_suppkey, 'Supplier', s_suppkey, 'Nation', s_nationkey FROM supplier
  UNION ALL SELECT 'in_region', n_nationkey, 'Nation', n_nationkey, 'Region', n_regionkey FROM nation
),
arrows AS (
  SELECT edge_type, edge_id, 'out' AS direction, from_type AS src_type, from_id AS src_id, to_type AS dst_type, to_id AS dst_id FROM edges
  UNION ALL SELECT edge_type, edge_id, 'in', to_type, to_id, from_type, from_id FROM edges
)"""


def _steps(kind: str, limit: int, where: str = "true") -> str:
    return f"""{_EDGES},
steps AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_type, src_id, edge_type ORDER BY direction DESC, edge_id, dst_type, dst_id) AS rn FROM arrows WHERE src_type = '{kind}' AND {where}) WHERE rn <= {limit}
)"""


ORACLE_SQL["neighbors_out"] = f"""WITH {_steps("Customer", 100, "direction = 'out'")} SELECT src_id, edge_type, edge_id, dst_type, dst_id FROM steps"""
ORACLE_SQL["neighbors_in"] = f"""WITH {_steps("Part", 10, "direction = 'in'")} SELECT src_id, edge_type, edge_id, dst_type, dst_id FROM steps WHERE src_id IN (SELECT p_partkey FROM part)"""
ORACLE_SQL["neighbors_both"] = f"""WITH {_steps("Supplier", 50)}
SELECT src_id, dst_type, dst_id, arg_min(edge_type, (direction <> 'out', edge_type, edge_id)) AS edge_type, count(*) AS n_edges, string_agg(DISTINCT direction, ',' ORDER BY direction DESC) AS directions FROM steps GROUP BY src_id, dst_type, dst_id"""
ORACLE_SQL["neighbors_by_edge_type"] = f"""WITH {_steps("Nation", 40, "edge_type IN ('located_in', 'in_region')")} SELECT src_id, edge_type, direction, count(*) AS n, max(edge_id) AS last_edge FROM steps GROUP BY ALL"""
ORACLE_SQL["traverse_nodes"] = f"""WITH RECURSIVE {_EDGES},
walk AS (SELECT 'Region' AS type, 0::BIGINT AS id, 0::BIGINT AS d UNION ALL SELECT dst_type, dst_id, d + 1 FROM walk JOIN arrows ON src_type = type AND src_id = id AND direction = 'in' WHERE d < 3),
counted AS (SELECT type, id, d, count(*) AS n FROM walk GROUP BY ALL)
SELECT type, id, min(d) AS min_depth, arg_min(n, d) AS paths_count FROM counted GROUP BY type, id HAVING min(d) > 0"""


def _paths(direction: str, depth: int) -> str:
    return f"""{_EDGES},
step AS (SELECT src_type, src_id, dst_type, dst_id, min(edge_type || ':' || edge_id) AS edge FROM arrows WHERE {direction} GROUP BY ALL),
walk AS (
  SELECT 'Customer' AS type, 7::BIGINT AS id, 'Customer:7' AS nodes, '' AS edges, 0::BIGINT AS depth
  UNION ALL SELECT dst_type, dst_id, nodes || '>' || dst_type || ':' || dst_id, CASE WHEN depth = 0 THEN edge ELSE edges || '>' || edge END, depth + 1
  FROM walk JOIN step ON src_type = type AND src_id = id WHERE depth < {depth} AND ('>' || nodes || '>') NOT LIKE '%>' || dst_type || ':' || dst_id || '>%' AND NOT (type = 'Supplier' AND id = 3 AND {"true" if direction == "true" else "false"})
)"""


ORACLE_SQL["traverse_paths"] = f"""WITH RECURSIVE {_paths("direction = 'out'", 3)} SELECT nodes, edges, depth FROM walk WHERE depth > 0"""
ORACLE_SQL["find_paths"] = f"""WITH RECURSIVE {_paths("true", 3)} SELECT nodes, edges, depth FROM walk WHERE type = 'Supplier' AND id = 3 ORDER BY depth, string_split(nodes, '>') LIMIT 10"""
_SUB = f"""{_EDGES},
walk AS (SELECT 'Order' AS type, 7::BIGINT AS id, 0::BIGINT AS d UNION SELECT dst_type, dst_id, d + 1 FROM walk JOIN arrows ON src_type = type AND src_id = id WHERE d < 2),
sub AS (SELECT type, id, min(d) AS min_depth FROM walk GROUP BY ALL ORDER BY min_depth, type, id LIMIT 100)"""
ORACLE_SQL["extract_subgraph_nodes"] = f"WITH RECURSIVE {_SUB} SELECT type, id, min_depth FROM sub"
ORACLE_SQL["extract_subgraph_edges"] = f"WITH RECURSIVE {_SUB} SELECT edge_type, edge_id, from_type, from_id, to_type, to_id FROM edges WHERE (from_type, from_id) IN (SELECT (type, id) FROM sub) AND (to_type, to_id) IN (SELECT (type, id) FROM sub) ORDER BY edge_type, edge_id LIMIT 200"
ORACLE_SQL["graph_search_context"] = f"""WITH {_BM25}, {_COSINE}, {_hybrid(0.5, 5)},
src AS (SELECT doc_id, substr(source, 4)::BIGINT AS source FROM documents),
near AS (SELECT source, doc_id AS node FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM src) WHERE rn <= 10)
SELECT id AS seed, score, source, node FROM hybrid JOIN src ON doc_id = id JOIN near USING (source) WHERE node <> id"""

ORACLE_SQL["sql_filter_order"] = "SELECT p_partkey, p_name, p_size FROM part WHERE p_size > 40 ORDER BY p_size DESC, p_partkey LIMIT 50"
ORACLE_SQL["sql_group_agg"] = "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag, l_linestatus"
ORACLE_SQL["sql_join3"] = "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM customer JOIN orders ON o_custkey = c_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name"
ORACLE_SQL["sql_window"] = "SELECT o_custkey, o_orderkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS prev FROM orders"
ORACLE_SQL["sql_setops"] = "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT 3"
ORACLE_SQL["sql_rollup"] = "SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ROLLUP (p_brand, p_type)"
ORACLE_SQL["sql_cube"] = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)"
ORACLE_SQL["sql_semi_anti"] = "SELECT count(*) AS n, round(sum(c_acctbal), 2) AS bal FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 1000) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"
ORACLE_SQL["sql_json_props"] = "SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY ALL"
ORACLE_SQL["sql_date_bucket"] = "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2"
ORACLE_SQL["sql_recursive"] = "SELECT n_name, n_nationkey AS d FROM nation"
ORACLE_SQL["sql_full_outer"] = "SELECT r_name, n_name FROM region FULL OUTER JOIN nation ON n_regionkey = r_regionkey AND n_nationkey % 2 = 0"
ORACLE_SQL["sql_asof"] = "SELECT o_orderkey, strftime(ts, '%Y-%m-%d %H:%M:%S') AS last_event FROM (SELECT o_orderkey, o_orderdate, o_custkey % 100 AS k FROM orders) o ASOF LEFT JOIN (SELECT ts, user_id % 100 AS k FROM events) e ON o.k = e.k AND o.o_orderdate >= e.ts"
ORACLE_SQL["sql_auto_limit"] = "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 1000"
ORACLE_SQL["sql_pivot"] = "SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"
ORACLE_SQL["sql_unpivot"] = "SELECT p_partkey, 'size' AS k, p_size::DOUBLE AS v FROM part WHERE p_size IS NOT NULL UNION ALL SELECT p_partkey, 'price', p_retailprice FROM part WHERE p_retailprice IS NOT NULL"
ORACLE_SQL["sql_lateral"] = "SELECT n_name, c_custkey, c_acctbal FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE c_acctbal > 0"
ORACLE_SQL["sql_frame_rows"] = "SELECT event_id, round(sum(value) OVER w, 6) AS v3, count(*) OVER w AS n3 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"
ORACLE_SQL["sql_frame_interval"] = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n_day FROM events"
ORACLE_SQL["sql_qualify_latest"] = "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1"
ORACLE_SQL["sql_setops_all"] = "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier EXCEPT ALL SELECT n_nationkey FROM nation"
ORACLE_SQL["sql_union_all"] = "SELECT k, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier) GROUP BY k"
ORACLE_SQL["sql_grouping_sets"] = "SELECT p_brand, p_size, grouping(p_brand)::TINYINT AS no_brand, count(*) AS n FROM part GROUP BY GROUPING SETS ((p_brand), (p_size), ())"
ORACLE_SQL["sql_agg_filter"] = "SELECT l_returnflag, count(*) FILTER (l_discount > 0.05) AS cheap, count(DISTINCT l_suppkey) FILTER (l_quantity > 25) AS suppliers, median(l_quantity) AS mid, arg_max(l_orderkey, (l_extendedprice, l_orderkey)) AS dearest FROM lineitem GROUP BY l_returnflag"
ORACLE_SQL["sql_theta_join"] = "SELECT r_name, n_name FROM region JOIN nation ON n_regionkey < r_regionkey AND n_nationkey > r_regionkey * 3"
ORACLE_SQL["sql_anti_join"] = "SELECT c_custkey FROM customer ANTI JOIN orders ON o_custkey = c_custkey AND o_totalprice > 100000"
ORACLE_SQL["sql_arrays"] = "SELECT doc_id, len(list_filter(w, lambda x: length(x) > 5)) AS long_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS letters, list_max(w) AS last_word FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"
ORACLE_SQL["sql_strings"] = "SELECT p_partkey, regexp_replace(p_name, '[aeiou]', '*', 'g') AS masked, upper(substring(p_name, 1, 3)) AS head, p_name ILIKE '%A%' AS has_a, lpad(p_size::VARCHAR, 4, '0') AS size4, split_part(p_type, ' ', 1) AS kind FROM part"
ORACLE_SQL["sql_star_except"] = "SELECT * EXCLUDE (p_retailprice), try_cast(p_name AS INT) AS n, p_size::VARCHAR || 'x' AS size_x FROM part"
ORACLE_SQL["sql_sample"] = "SELECT count(*) AS n FROM part"
ORACLE_SQL["chunk_sentences"] = """
SELECT doc_id, len(c)::BIGINT AS chunks, list_max(list_transform(c, lambda y: length(y)))::BIGINT AS longest
FROM (
  SELECT doc_id, CASE WHEN length(text) <= 400 THEN [text] ELSE list_transform(string_split(
    list_reduce(regexp_extract_all(text, '(?s)[^。！？.!?]*[。！？.!?]\\s*|[^。！？.!?]+$'), lambda a, x: CASE WHEN length(string_split(a, chr(30))[-1]) + length(x) > 400 THEN a || chr(30) || x ELSE a || x END),
    chr(30)), lambda y: regexp_replace(y, '^\\s+|\\s+$', '', 'g')) END AS c
  FROM documents WHERE text <> ''
)"""
ORACLE_SQL["node_delete"] = "SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"
ORACLE_SQL["edge_delete"] = "SELECT l_orderkey AS __from_id, count(*) AS n, max(l_partkey) AS last_part FROM (SELECT l_orderkey, l_partkey FROM lineitem EXCEPT SELECT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 25) GROUP BY 1"
ORACLE_SQL["load_jsonl"] = """
WITH last AS (SELECT o_custkey AS key, o_orderstatus AS status FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1)
SELECT coalesce(c_custkey, (SELECT max(c_custkey) FROM customer) + row_number() OVER (PARTITION BY c_custkey IS NULL ORDER BY key)) AS __id, coalesce(c_custkey, key) AS key, status FROM customer FULL OUTER JOIN last ON key = c_custkey
"""
ORACLE_SQL["vector_write_back"] = "SELECT vec_id::VARCHAR AS content_hash, round((CASE WHEN label % 2 = 0 THEN embedding[1] WHEN label % 3 <> 0 THEN -embedding[1] END)::DOUBLE, 5) AS first FROM embeddings"
ORACLE_SQL["cache_upsert"] = """
WITH h AS (SELECT doc_id, lang, md5(text) AS content_hash FROM documents),
old AS (SELECT DISTINCT content_hash FROM h WHERE lang = 'en'),
new AS (SELECT content_hash, max(CASE WHEN doc_id % 3 = 1 THEN 'new' END) AS fts FROM h WHERE doc_id % 3 <> 0 GROUP BY 1)
SELECT coalesce(o.content_hash, n.content_hash) AS content_hash, coalesce(n.fts, CASE WHEN o.content_hash IS NOT NULL THEN 'old' END) AS fts_content, CASE WHEN n.content_hash IS NOT NULL THEN '2024-02-01' ELSE '2024-01-01' END AS last_used
FROM old o FULL OUTER JOIN new n ON o.content_hash = n.content_hash
"""
_PARTS = "SELECT p_partkey AS source_id, {} AS fts_content FROM part p LEFT JOIN (SELECT DISTINCT md5(p_name) AS h FROM part WHERE p_size > 25 AND p_name <> '') c ON c.h = md5(p_name) WHERE p_name <> ''"
ORACLE_SQL["index_with_cache"] = _PARTS.format("CASE WHEN h IS NOT NULL THEN 'cached' ELSE array_to_string(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}]+'), ' ') END")
ORACLE_SQL["index_from_cache"] = _PARTS.format("CASE WHEN h IS NOT NULL THEN 'cached' END")
ORACLE_SQL["embed_contents"] = "SELECT DISTINCT md5(c) AS content_hash, length(c) AS chars, length(c) - length(replace(c, 'a', '')) AS letters_a FROM (SELECT p_name AS c FROM part UNION ALL SELECT p_type FROM part) WHERE c <> ''"
ORACLE_SQL["search_content"] = f"WITH {_BM25}, best AS (SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20) SELECT 'documents' AS source_table, doc_id AS source_id, score, md5(text) AS content_hash FROM best JOIN documents ON doc_id = id"
ORACLE_SQL["fts_postings"] = ORACLE_SQL["fts_block_max"] = ORACLE_SQL["fts_bm25"]
ORACLE_SQL["table_changes_merged"] = ORACLE_SQL["table_changes_rewritten"] = """
SELECT o_orderkey, o_custkey, CASE WHEN o_orderstatus = 'F' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice
FROM orders WHERE o_orderpriority IS DISTINCT FROM '5-LOW' UNION ALL SELECT -c_custkey - 1, c_custkey, 'N', c_acctbal FROM customer
"""
ORACLE_SQL["index_slice_stats"] = "SELECT lang AS source_table, count(DISTINCT doc_id) AS documents, count(t) AS chunks, coalesce(sum(len(t)), 0)::BIGINT AS tokens FROM (SELECT doc_id, lang, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents) GROUP BY lang"
ORACLE_SQL["index_incremental"] = "SELECT p_partkey AS source_id, content, md5(content) AS content_hash FROM (SELECT p_partkey, CASE WHEN p_size > 40 THEN p_name || ' renewed' ELSE p_name END AS content FROM part) WHERE content <> ''"

ORACLE_SQL["interval_overlaps"] = """
WITH e AS (SELECT user_id, epoch_us(ts) AS a, epoch_us(ts) + round(value * 60000000)::BIGINT AS b FROM events WHERE event_type = 'error'),
o AS (SELECT user_id, event_type, epoch_us(ts) AS a, epoch_us(ts) + round(value * 1000000)::BIGINT AS b FROM events WHERE event_type <> 'error')
SELECT user_id, event_type, count(*) AS n, sum(least(e.b, o.b) - greatest(e.a, o.a))::BIGINT AS micros
FROM e JOIN o USING (user_id) WHERE e.a <= o.b AND o.a <= e.b AND e.a <= e.b AND o.a <= o.b GROUP BY ALL
"""
ORACLE_SQL["vector_clusters"] = ORACLE_SQL["vector_topk"]
ORACLE_SQL["vector_clusters_filtered"] = ORACLE_SQL["vector_topk_filtered"]
ORACLE_SQL["graph_context"] = f"""WITH {_EDGES},
steps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src_type, src_id, edge_type ORDER BY direction DESC, edge_id, dst_type, dst_id) AS rn FROM arrows) WHERE rn <= 5),
seeds AS (SELECT 'Supplier' AS type, s_suppkey AS id FROM supplier UNION SELECT 'Nation', n_nationkey FROM nation),
near AS (SELECT s.type AS seed_type, s.id AS seed_id, 1::BIGINT AS depth, t.* FROM seeds s JOIN steps t ON src_type = type AND src_id = id WHERE (dst_type, dst_id) <> (type, id)),
far AS (
  SELECT n.seed_type, n.seed_id, 2::BIGINT AS depth, t.* FROM (SELECT DISTINCT seed_type, seed_id, dst_type, dst_id FROM near) n JOIN steps t ON t.src_type = n.dst_type AND t.src_id = n.dst_id
  WHERE (t.dst_type, t.dst_id) <> (n.seed_type, n.seed_id) AND (n.seed_type, n.seed_id, t.dst_type, t.dst_id) NOT IN (SELECT (seed_type, seed_id, dst_type, dst_id) FROM near)
)
SELECT seed_type, seed_id, depth, dst_type AS type, dst_id AS id, edge_type, edge_id, direction, src_type AS from_type, src_id AS from_id FROM (
  SELECT *, row_number() OVER (PARTITION BY seed_type, seed_id, dst_type, dst_id ORDER BY direction DESC, edge_type, edge_id, src_type, src_id) AS best FROM (FROM near UNION ALL FROM far)
) WHERE best = 1"""


def _sampled(k: int, stratum: str, salt: str, priority: str, chance: str) -> str:
    return f"""
WITH h AS (SELECT *, (('0x' || substr(md5('{salt}:' || o_orderkey), 1, 13))::BIGINT + 1)::DOUBLE / 4503599627370496.0 AS share FROM orders),
p AS (SELECT *, {priority} AS priority FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY priority) AS rn FROM p WHERE priority IS NOT NULL),
b AS (SELECT *, max(CASE WHEN rn = {k + 1} THEN priority END) OVER (PARTITION BY {stratum}) AS bound FROM r)
SELECT o_orderkey, {stratum}, coalesce({chance}, 1.0::DOUBLE) AS chance FROM b WHERE rn <= {k}"""


ORACLE_SQL["sample_stratified"] = _sampled(20, "o_orderpriority", "", "share", "round(bound, 9)")
ORACLE_SQL["sample_weighted"] = _sampled(25, "o_orderstatus", "w", "CASE WHEN o_totalprice > 0 THEN -ln(share) / o_totalprice END", "round(1 - exp(-o_totalprice * bound), 6)")
ORACLE_SQL["stream_latest"] = "SELECT user_id, event_id, event_type, value FROM events WHERE user_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC NULLS LAST, event_id DESC) = 1"
ORACLE_SQL["index_sketches"] = """
WITH d AS (SELECT doc_id, unnest([lang, 'all']) AS source_table, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS t FROM documents),
w AS (SELECT source_table, count(DISTINCT term) AS terms FROM (SELECT source_table, unnest(t) AS term FROM d) GROUP BY 1)
SELECT source_table, count(DISTINCT doc_id) AS documents, any_value(terms) AS terms, true AS documents_near, true AS terms_near, true AS half_near FROM d JOIN w USING (source_table) GROUP BY 1
"""
ORACLE_SQL["dump_by_date"] = "SELECT coalesce(strftime(ts, '%Y%m%d'), 'unknown') AS dt, event_type, count(*) AS n, min(event_id) AS first_id, max(ts) AS last_at, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
