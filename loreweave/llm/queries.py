"""The operators' queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from loreweave.llm.bpe_codec import bpe_encode
from loreweave.llm.cross_tokenizer import cross_tokenizer
from loreweave.llm.decontaminate import decontaminate
from loreweave.llm.exact_dedup import exact_dedup
from loreweave.llm.language_id import language_id
from loreweave.llm.lattice_lm import lattice_lm
from loreweave.llm.near_dedup import near_dedup
from loreweave.llm.simhash_dedup import simhash_dedup
from loreweave.llm.substring_dedup import substring_dedup
from loreweave.llm.suffix_dedup import suffix_dedup
from loreweave.llm.token_counts import token_counts
from loreweave.llm.warc import archive_and_read


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_and_read(_table(spark, sf_dir, "pages"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), items_without_id=True)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents"))


def op9_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score is the model that has learned; lattice_score sums segmentations to pieces alone."""
    scored = lattice_lm(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), rounds=2)
    return scored.withColumnsRenamed({"score": "lattice_score", "model_score": "score"})


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op11_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_suffix_dedup, op2_bpe_codec, op3_language_id, op4_warc, op5_exact_dedup, op6_decontaminate, op7_token_counts, op8_substring_dedup, op9_lattice_lm, op10_near_dedup, op11_cross_tokenizer, op12_simhash_dedup)}

ORACLE_SQL: dict[str, str] = {}

ORACLE_SQL["op1_suffix_dedup"] = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
wins AS (
  SELECT doc_id, p, sha256(substr(h, 2 * p + 1, 200)) AS s
  FROM (SELECT doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) AS p FROM docs)
),
gone AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS rn FROM wins) WHERE rn > 1),
edges AS (
  SELECT doc_id, p, CASE WHEN p <= max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100 THEN 0 ELSE 1 END AS is_new FROM gone
),
runs AS (SELECT doc_id, p, sum(is_new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM edges),
spans AS (SELECT doc_id, run, min(p) AS a, max(p) + 100 AS b FROM runs GROUP BY doc_id, run),
cuts AS (
  SELECT doc_id, coalesce(lag(b) OVER w, 0) AS keep_from, a AS keep_to, b, count(*) OVER (PARTITION BY doc_id) AS n, row_number() OVER w AS i FROM spans WINDOW w AS (PARTITION BY doc_id ORDER BY a)
),
kept AS (
  SELECT c.doc_id, any_value(c.n) AS n_spans, sum(c.b - c.keep_to) AS n_removed,
         string_agg(substr(h, 2 * keep_from + 1, 2 * (keep_to - keep_from)), '' ORDER BY i) || substr(any_value(h), 2 * max(b) + 1) AS k
  FROM cuts c JOIN docs d USING (doc_id) GROUP BY c.doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL["op4_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d, sha256(coalesce(html, '')) AS k FROM pages),
firsts AS (SELECT k, min(page_id) AS first_id FROM p GROUP BY k),
bits AS (SELECT page_id, array_to_string(list_transform(range(1, 41), lambda i: right(bin(16 + instr('0123456789abcdef', d[i]) - 1), 4)), '') AS b FROM p)
SELECT p.page_id, octet_length(encode(h))::BIGINT AS payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + 16 * b[5 * i + 1]::INT + 8 * b[5 * i + 2]::INT + 4 * b[5 * i + 3]::INT + 2 * b[5 * i + 4]::INT + b[5 * i + 5]::INT]), '') AS payload_digest,
       CASE WHEN p.page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN p.page_id <> first_id THEN first_id END AS refers_to
FROM p JOIN firsts USING (k) JOIN bits USING (page_id)
"""

ORACLE_SQL["op5_exact_dedup"] = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""

ORACLE_SQL["op6_decontaminate"] = """
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, w[i + 1 : i + 10] AS g
  FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 9))) AS i FROM iw WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT len(g) AS n FROM windows),
grams AS (SELECT doc_id, i, w[i + 1 : i + n] AS g FROM (SELECT doc_id, n, w, unnest(range(0, greatest(0, len(w) - n + 1))) AS i FROM dw, lengths)),
found AS (SELECT doc_id, i, g, item_id FROM grams JOIN windows USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + len(g))) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL["op8_substring_dedup"] = """
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
wins AS (SELECT doc_id, i, sha256(array_to_string(w[i + 1 : i + 35], ' ')) AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(0, len(w) - 34))) AS i FROM dw)),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY s) AS n FROM wins) WHERE n > 1),
gone AS (SELECT doc_id, list(p) AS ps FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM dup) GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM dw),
gonep AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS k FROM words ANTI JOIN gonep USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM dw d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL["op10_near_dedup"] = """
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(1, len(w) - 2))) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM both_ JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM dw UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT dw.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, dw.doc_id = c.component_id AS kept
FROM dw LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x) c USING (doc_id)
"""
