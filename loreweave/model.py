"""Ontology and configuration of a knowledge base, and their Spark schemas."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import types as T

from loreweave.errors import InvalidTableNameError

#: Limits, defaults and names that callers rely on.
QUERY_LIMIT = 1000
RESULT_BYTES = 2 * 1024 * 1024
CARDINALITIES = ("1:1", "1:N", "N:1", "N:N")
METRICS = ("cosine", "l2", "inner")
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")
#: Both give the same tokens: the second is a dictionary's name that configurations may have, read as the first.
TOKENIZERS = ("unicode", "jieba")
INDEX_TABLE = "_sys_search_index"
CACHE_TABLE = "_sys_search_cache"
POSTINGS_TABLE = "_sys_search_postings"
STATS_TABLE = "_sys_search_stats"
LINKS_TABLE = "_sys_links"

_IDENTIFIER = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")
_BY_TYPE = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType(), "array": T.StringType(), "object": T.StringType(), "null": T.StringType()}
#: A format decides whatever the type; Spark has no plain time of day, which stays HH:mm:ss text.
_BY_FORMAT = {"date-time": T.TimestampNTZType(), "date": T.DateType(), "time": T.StringType()}

_NAMED = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "vector": T.ArrayType(T.FloatType()), "timestamp": T.TimestampNTZType()}


def _struct(fields: str) -> T.StructType:
    return T.StructType([T.StructField(n, _NAMED[t]) for n, t in (f.split() for f in fields.split(", "))])


INDEX_SCHEMA = _struct("id long, source_table string, source_id long, source_field string, chunk_seq int, content string, fts_content string, vector vector, content_hash string, created_at timestamp")
POSTINGS_SCHEMA = _struct("source_table string, id long, dl long, term string, tf long")
STATS_SCHEMA = _struct("source_table string, documents long, chunks long, tokens long")
LINKS_SCHEMA = _struct("edge_id long, from_id long, to_id long")
CACHE_SCHEMA = _struct("content_hash string, fts_content string, vector vector, last_used timestamp, created_at timestamp")


def table_name(name: str) -> str:
    if not name:
        raise InvalidTableNameError(name, "it is empty")
    if not _IDENTIFIER.fullmatch(name):
        raise InvalidTableNameError(name, "only letters, digits and underscores, not beginning with a digit")
    if len(name) > 64:
        raise InvalidTableNameError(name, "it is longer than 64 characters")
    return name


def spark_type(prop: dict[str, Any]) -> T.DataType:
    return _BY_FORMAT.get(prop.get("format") or "") or _BY_TYPE.get(prop.get("type") or "string", T.StringType())


def _only(what: str, data: dict[str, Any], allowed: set[str]) -> None:
    if extra := set(data) - allowed:
        raise ValueError(f"{what}: unknown keys {sorted(extra)}")


@dataclass(frozen=True)
class VectorConfig:
    dim: int
    model: str
    metric: str = "cosine"

    def __post_init__(self) -> None:
        if self.dim <= 0:
            raise ValueError("vector dim must be positive")
        if self.metric not in METRICS:
            raise ValueError(f"vector metric must be one of {', '.join(METRICS)}")


@dataclass(frozen=True)
class NodeType:
    name: str
    table: str
    identity: tuple[str, ...]
    properties: dict[str, dict[str, Any]] = field(default_factory=dict)
    schema: dict[str, Any] | None = None
    vectors: dict[str, VectorConfig] = field(default_factory=dict)
    full_text: tuple[str, ...] = ()
    vector_fields: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        table_name(self.table)
        if not self.identity:
            raise ValueError(f"node {self.name}: identity must not be empty")

    @property
    def searched(self) -> tuple[str, ...]:
        return tuple(dict.fromkeys((*self.full_text, *self.vector_fields)))

    @property
    def columns(self) -> dict[str, T.DataType]:
        props = {k: spark_type(v) for k, v in self.properties.items()}
        return {k: props.get(k, T.StringType()) for k in dict.fromkeys((*props, *self.identity))}

    @property
    def struct(self) -> T.StructType:
        system = [T.StructField("__id", T.LongType(), False), T.StructField("__created_at", T.TimestampNTZType()), T.StructField("__updated_at", T.TimestampNTZType())]
        return T.StructType(system + [T.StructField(k, t) for k, t in self.columns.items()])


@dataclass(frozen=True)
class EdgeType:
    name: str
    source: str
    target: str
    cardinality: str = "N:N"
    properties: dict[str, dict[str, Any]] = field(default_factory=dict)
    index_from: bool = True
    index_to: bool = True

    def __post_init__(self) -> None:
        if self.cardinality not in CARDINALITIES:
            raise ValueError(f"edge {self.name}: cardinality must be one of {', '.join(CARDINALITIES)}")

    @property
    def table(self) -> str:
        return table_name(f"edge_{self.name}")

    @property
    def columns(self) -> dict[str, T.DataType]:
        return {k: spark_type(v) for k, v in self.properties.items()}

    @property
    def struct(self) -> T.StructType:
        long = T.LongType()
        system = [T.StructField("__id", long, False), T.StructField("__from_id", long, False), T.StructField("__to_id", long, False), T.StructField("__created_at", T.TimestampNTZType()), T.StructField("__updated_at", T.TimestampNTZType())]
        return T.StructType(system + [T.StructField(k, t) for k, t in self.columns.items()])


@dataclass(frozen=True)
class Ontology:
    nodes: dict[str, NodeType] = field(default_factory=dict)
    edges: dict[str, EdgeType] = field(default_factory=dict)

    def __post_init__(self) -> None:
        for e in self.edges.values():
            for end in (e.source, e.target):
                if end not in self.nodes:
                    raise ValueError(f"edge {e.name}: unknown node type {end}")

    def node(self, name: str) -> NodeType:
        if name not in self.nodes:
            raise ValueError(f"Unknown node type: {name}")
        return self.nodes[name]

    def by_table(self, table: str) -> str | None:
        return next((k for k, n in self.nodes.items() if n.table == table), None)

    @classmethod
    def parse(cls, data: dict[str, Any]) -> Ontology:
        _only("ontology", data, {"nodes", "edges"})
        nodes, edges = {}, {}
        for name, n in (data.get("nodes") or {}).items():
            _only(f"node {name}", n, {"table", "identity", "schema", "vectors", "search"})
            search = n.get("search") or {}
            _only(f"node {name} search", search, {"full_text", "vectors"})
            schema = n.get("schema") or {}
            vectors = {k: VectorConfig(**v) for k, v in (n.get("vectors") or {}).items()}
            nodes[name] = NodeType(name, n.get("table") or "", tuple(n.get("identity") or ()), schema.get("properties") or {}, schema or None, vectors, tuple(search.get("full_text") or ()), tuple(search.get("vectors") or ()))
        for name, e in (data.get("edges") or {}).items():
            _only(f"edge {name}", e, {"from", "to", "cardinality", "schema", "index"})
            index = e.get("index") or {}
            edges[name] = EdgeType(name, e["from"], e["to"], e.get("cardinality") or "N:N", (e.get("schema") or {}).get("properties") or {}, index.get("from", True), index.get("to", True))
        return cls(nodes, edges)


@dataclass(frozen=True)
class RRF:
    """k of reciprocal-rank fusion: fixed, or by the number of documents in steps, within bounds."""

    auto_k: bool = True
    k: int = 60
    min_k: int = 5
    max_k: int = 60
    strategy: str = "document_count"
    thresholds: tuple[tuple[float, int], ...] = ((10_000, 10), (100_000, 20), (1_000_000, 40), (float("inf"), 60))

    def of(self, documents: int) -> int:
        if not self.auto_k:
            return self.k
        k = next((k for most, k in self.thresholds if documents <= most), self.max_k)
        return max(self.min_k, min(self.max_k, k))


@dataclass(frozen=True)
class Config:
    ontology: Ontology = field(default_factory=Ontology)
    embedding_model: str = "text-embedding-3-small"
    embedding_dim: int = 1536
    embedding_url: str | None = None
    chunk_size: int = 800
    chunk_overlap: int = 100
    tokenizer: str = "unicode"
    rrf: RRF = field(default_factory=RRF)
    data_dir: str | None = None
    max_rows_per_file: int = 1000
    log_level: str = "INFO"
    usage_instructions: str | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.embedding_dim <= 4096:
            raise ValueError("embedding dim must be 1 to 4096")
        if not 100 <= self.chunk_size <= 8000:
            raise ValueError("chunk_size must be 100 to 8000")
        if not 0 <= self.chunk_overlap < self.chunk_size:
            raise ValueError("chunk_overlap must be less than chunk_size")
        if not 100 <= self.max_rows_per_file <= 10_000:
            raise ValueError("max_rows_per_file must be 100 to 10000")
        if self.tokenizer not in TOKENIZERS:
            raise ValueError(f"tokenizer must be one of {', '.join(TOKENIZERS)}")
        if self.log_level not in LOG_LEVELS:
            raise ValueError(f"log_level must be one of {', '.join(LOG_LEVELS)}")

    @classmethod
    def from_yaml(cls, path: str | Path) -> Config:
        """A missing file gives the defaults."""
        path = Path(path)
        return cls.parse(yaml.safe_load(path.read_text(encoding="utf-8")) or {}) if path.exists() else cls()

    @classmethod
    def parse(cls, data: dict[str, Any]) -> Config:
        embedding, storage = data.get("embedding") or {}, data.get("storage") or {}
        rrf = (data.get("search") or {}).get("rrf") or {}
        steps = rrf.get("thresholds")
        fusion = RRF(**{k: rrf[k] for k in ("auto_k", "k", "min_k", "max_k", "strategy") if k in rrf}, **({"thresholds": tuple((float(t["max_docs"]), int(t["k"])) for t in steps)} if steps else {}))
        plain = {k: data[k] for k in ("chunk_size", "chunk_overlap", "tokenizer", "log_level", "usage_instructions") if k in data}
        plain |= {k: v for k, v in (("embedding_model", embedding.get("model")), ("embedding_dim", embedding.get("dim")), ("embedding_url", embedding.get("url")), ("data_dir", storage.get("data_dir")), ("max_rows_per_file", storage.get("max_rows_per_file"))) if v is not None}
        return cls(ontology=Ontology.parse(data.get("ontology") or {}), rrf=fusion, **plain)
