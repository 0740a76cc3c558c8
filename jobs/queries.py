"""The jobs as queries over the driver's tables, and SQL for what they leave behind."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs.build_graph import build_graph
from jobs.index_documents import index_documents
from loreweave.plans.driver_sql import chunks_sql
from loreweave.shared import shared_folder


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_index_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after two runs into one folder, of which the second finds nothing new."""
    at = _new_folder(spark, "job1")
    for _ in range(2):
        out = index_documents(spark, f"{sf_dir}/documents.parquet", f"{at}/index", f"{at}/checkpoint")
    return out


def job2_build_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The graph after two runs into one folder."""
    at = _new_folder(spark, "job2")
    for _ in range(2):
        out = build_graph(spark, sf_dir, f"{at}/graph")
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_index_documents, job2_build_graph)}

_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY text DESC NULLS LAST, lang DESC NULLS LAST) AS rn FROM documents WHERE doc_id IS NOT NULL) WHERE rn = 1)"

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["job1_index_documents"] = f"""
WITH {_LATEST}, {chunks_sql(800, 100, "latest")},
words AS (SELECT doc_id, chunk_seq, content, regexp_extract_all(lower(content), '[\\p{{L}}\\p{{N}}]+') AS t FROM chunks),
each AS (SELECT doc_id, chunk_seq, term, count(*) AS tf FROM (SELECT doc_id, chunk_seq, unnest(t) AS term FROM words) GROUP BY ALL)
SELECT 'chunk' AS part, md5(content) AS key, doc_id, chunk_seq, len(t)::BIGINT AS n, NULL::BIGINT AS tf FROM words
UNION ALL SELECT 'term', term, NULL, NULL, count(*), sum(tf)::BIGINT FROM each GROUP BY term
"""

ORACLE_SQL["job2_build_graph"] = """
WITH nodes AS (
  SELECT kind, id, min(name) AS name FROM (
    SELECT 'Customer' AS kind, c_custkey AS id, c_name AS name FROM customer WHERE c_acctbal >= 0
    UNION ALL SELECT 'Order', o_orderkey, o_orderpriority FROM orders
    UNION ALL SELECT 'Part', p_partkey, p_name FROM part
    UNION ALL SELECT 'Supplier', s_suppkey, s_name FROM supplier
    UNION ALL SELECT 'Nation', n_nationkey, n_name FROM nation
    UNION ALL SELECT 'Region', r_regionkey, r_name FROM region) WHERE id IS NOT NULL GROUP BY ALL
),
said AS (
  SELECT 'placed' AS edge_type, 'Customer' AS from_type, o_custkey AS from_id, 'Order' AS to_type, o_orderkey AS to_id FROM orders
  UNION ALL SELECT 'contains', 'Order', l_orderkey, 'Part', l_partkey FROM lineitem
  UNION ALL SELECT 'supplied_by', 'Part', l_partkey, 'Supplier', l_suppkey FROM lineitem
  UNION ALL SELECT 'located_in', 'Customer', c_custkey, 'Nation', c_nationkey FROM customer
  UNION ALL SELECT 'based_in', 'Supplier', s_suppkey, 'Nation', s_nationkey FROM supplier
  UNION ALL SELECT 'in_region', 'Nation', n_nationkey, 'Region', n_regionkey FROM nation
),
edges AS (SELECT edge_type, from_type, from_id, to_type, to_id, count(*) AS n_rows FROM said GROUP BY ALL),
checked AS (
  SELECT e.*, CASE WHEN a.id IS NULL OR b.id IS NULL THEN 'dangling' ELSE 'valid' END AS status
  FROM edges e LEFT JOIN nodes a ON a.kind = from_type AND a.id = from_id LEFT JOIN nodes b ON b.kind = to_type AND b.id = to_id
),
leaving AS (SELECT from_type AS kind, from_id AS id, count(*) AS n FROM checked WHERE status = 'valid' GROUP BY ALL),
reaching AS (SELECT to_type AS kind, to_id AS id, count(*) AS n FROM checked WHERE status = 'valid' GROUP BY ALL)
SELECT status AS part, edge_type AS kind, from_id AS id, to_id AS other_id, NULL::VARCHAR AS name, n_rows AS n, NULL::BIGINT AS n_in FROM checked
UNION ALL SELECT 'node', kind, id, NULL, name, coalesce(l.n, 0), coalesce(r.n, 0) FROM nodes LEFT JOIN leaving l USING (kind, id) LEFT JOIN reaching r USING (kind, id)
"""
