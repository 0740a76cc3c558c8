"""A knowledge base: import, search, graph and SQL over versioned snapshots."""

from __future__ import annotations

import hashlib
import json
import math
import threading
from collections import defaultdict
from collections.abc import Callable
from datetime import UTC, date, datetime
from functools import partial, reduce, wraps
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.errors import ConflictError, KnowledgeBaseError, NodeNotFoundError, ValidationError
from loreweave.functions.text import content_hash, segment, tokens
from loreweave.functions.vector import literal
from loreweave.model import CACHE_SCHEMA, CACHE_TABLE, INDEX_SCHEMA, INDEX_TABLE, LINKS_SCHEMA, LINKS_TABLE, POSTINGS_SCHEMA, POSTINGS_TABLE, STATS_SCHEMA, STATS_TABLE, Config, EdgeType, NodeType, table_name
from loreweave.operators import graph, index, merge, search, sqlgate
from loreweave.shared import cut, temporary_tables, values
from loreweave.sources.embedder import HttpEmbedder
from loreweave.sources.files import Files
from loreweave.sources.store import Snapshots, Version, dump, read_bundle, read_jsonl
from loreweave.validate import bundle_schema, validate_bundle

#: Of each node type, identity fields of an edge end travel under these prefixes.
_ENDS = (("source", "__from_id"), ("target", "__to_id"))


def hashing_embedder(dim: int):
    """A deterministic embedder that needs no network: words hashed to signed dimensions, unit length."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out

    return embed


def _value(value: Any, kind: T.DataType) -> Any:
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, default=str)
    if isinstance(kind, T.TimestampNTZType):
        at = value if isinstance(value, datetime) else datetime.fromisoformat(str(value).replace("Z", "+00:00"))
        return at.astimezone(UTC).replace(tzinfo=None) if at.tzinfo else at
    if isinstance(kind, T.DateType):
        return value if isinstance(value, date) else date.fromisoformat(str(value))
    return float(value) if isinstance(kind, T.DoubleType) else value


def _now() -> Column:
    return F.lit(datetime.now(UTC).replace(tzinfo=None)).cast("timestamp_ntz")


def dictionary(text: str) -> list[str]:
    """Terms of a user dictionary, the first field of each line."""
    return [f[0] for f in map(str.split, text.splitlines()) if f]


def _ends_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("__id").alias("edge_id"), F.col("__from_id").alias("from_id"), F.col("__to_id").alias("to_id"))


def _in_order(ends: DataFrame, end: str) -> DataFrame:
    return ends.repartitionByRange(f"{end}_id", "edge_id").sortWithinPartitions(f"{end}_id", "edge_id")


def _one_version(read: Callable[..., Any]) -> Callable[..., Any]:
    """All that a method reads comes from the version that was current when it began."""

    @wraps(read)
    def call(self: Engine, *args: Any, **kw: Any) -> Any:
        with temporary_tables(self.spark), self.snapshots.pinned():
            return read(self, *args, **kw)

    return call


def _tidy(work: Callable[..., Any]) -> Callable[..., Any]:
    """Tables that a method cuts lineage with go when it ends."""

    @wraps(work)
    def call(self: Engine, *args: Any, **kw: Any) -> Any:
        with temporary_tables(self.spark):
            return work(self, *args, **kw)

    return call


class Engine:
    """Opens the knowledge base in a folder, of any file system that Hadoop knows; config.yaml declares it.

    Readers use immutable snapshots. The index is kept in a slice for each node type, with postings and statistics beside
    it; a change of nodes indexes those nodes only, and what it writes is about what it changes. Versions older than the
    last two and ``retention`` seconds go with each change. A session that was passed in is not stopped on close.
    """

    def __init__(self, spark: SparkSession, path: str | Path, config: Config | None = None, embedder: index.Embedder | None = None, retention: float = 3600.0) -> None:
        self.spark, self.path, self.files = spark, str(path).rstrip("/"), Files(spark)
        self.config = config or Config.parse(yaml.safe_load(self._text("config.yaml")) or {})
        self.ontology = self.config.ontology
        self.snapshots = Snapshots(self.config.data_dir or f"{self.path}/data", spark)
        remote = HttpEmbedder(self.config.embedding_url, self.config.embedding_model) if self.config.embedding_url else None
        self.embedder = embedder or remote or hashing_embedder(self.config.embedding_dim)
        self.words = dictionary(self._text("user_dict.txt"))
        self.retention = retention
        self._writer = threading.Lock()
        self._views: set[str] = set()

    def _text(self, name: str) -> str:
        """A file of the knowledge base; a missing one is empty."""
        at = f"{self.path}/{name}"
        return self.files.read(at) if self.files.exists(at) else ""

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Drops the views that register_views has made; files and session stay."""
        for name in self._views:
            self.spark.catalog.dropTempView(name)
        self._views = set()

    def _write(self, change: Callable[[], Any], tries: int = 5) -> Any:
        """Makes a change of one version, and anew of the next one if another writer has published meanwhile."""
        with self._writer, temporary_tables(self.spark):
            for left in reversed(range(tries)):
                try:
                    with self.snapshots.pinned():
                        done = change()
                    self.snapshots.prune(least_age=self.retention)
                    return done
                except ConflictError:
                    if not left:
                        raise

    # tables

    def nodes(self, node_type: str) -> DataFrame:
        n = self.ontology.node(node_type)
        return self.snapshots.read(self.spark, n.table, n.struct)

    def edges(self, name: str) -> DataFrame:
        e = self.ontology.edges[name]
        return self.snapshots.read(self.spark, e.table, e.struct)

    def index(self, node_type: str | None = None) -> DataFrame:
        """The index, or the slice of a node type."""
        return self._slices(INDEX_TABLE, INDEX_SCHEMA, node_type)

    def postings(self) -> DataFrame:
        return self._slices(POSTINGS_TABLE, POSTINGS_SCHEMA)

    def index_stats(self) -> DataFrame:
        return self._slices(STATS_TABLE, STATS_SCHEMA)

    def _slices(self, table: str, schema: T.StructType, node_type: str | None = None) -> DataFrame:
        return self.snapshots.read(self.spark, f"{table}.{self.ontology.node(node_type).table if node_type else '*'}", schema)

    def cache(self) -> DataFrame:
        return self.snapshots.read(self.spark, CACHE_TABLE, CACHE_SCHEMA)

    def links(self) -> graph.Graph:
        """All edges in both orders, as the graph operators take them."""
        empty = self.spark.createDataFrame([], "edge_type string, edge_id long, from_type string, from_id long, to_type string, to_id long")

        def every(end: str) -> DataFrame:
            parts = [self.snapshots.read(self.spark, f"{LINKS_TABLE}_{end}.{e.table}", LINKS_SCHEMA).select(F.lit(e.name).alias("edge_type"), "edge_id", F.lit(e.source).alias("from_type"), "from_id", F.lit(e.target).alias("to_type"), "to_id") for e in self.ontology.edges.values()]
            return reduce(DataFrame.unionByName, parts) if parts else empty

        return graph.Graph(every("from"), every("to"))

    def _write_edges(self, version: Version, e: EdgeType, rows: DataFrame) -> None:
        """A whole edge table, and its ends in order of either."""
        rows = version.write(e.table, rows)
        for end in ("from", "to"):
            version.write(f"{LINKS_TABLE}_{end}.{e.table}", _in_order(_ends_of(rows), end))

    def _change_edges(self, version: Version, e: EdgeType, rows: DataFrame, ids: DataFrame) -> None:
        """Rows take the place of the edges with these ids (__id)."""
        rows = version.change(e.table, rows, "__id", ids)
        for end in ("from", "to"):
            version.change(f"{LINKS_TABLE}_{end}.{e.table}", _ends_of(rows), "edge_id", ids.select(F.col("__id").alias("edge_id")), partial(_in_order, end=end))

    def tables(self) -> dict[str, DataFrame]:
        """All tables by name."""
        own = {n.table: self.nodes(n.name) for n in self.ontology.nodes.values()} | {e.table: self.edges(e.name) for e in self.ontology.edges.values()}
        return own | {INDEX_TABLE: self.index(), CACHE_TABLE: self.cache()}

    def _table(self, name: str) -> DataFrame:
        if (df := self.tables().get(table_name(name))) is None:
            raise ValueError(f"Unknown table: {name}")
        return df

    def table_exists(self, name: str) -> bool:
        return table_name(name) in self.tables()

    def table_columns(self, name: str) -> list[str]:
        return self._table(name).columns

    def table_count(self, name: str) -> int:
        return self._table(name).count()

    @_one_version
    def register_views(self, prefix: str = "") -> list[str]:
        """Temp views of all tables in the caller's session; a prefix keeps two knowledge bases apart."""
        tables = {f"{prefix}{name}": df for name, df in self.tables().items()}
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        self._views |= set(tables)
        return list(tables)

    # import

    def import_bundle(self, path: str | Path, *, delete: bool = False) -> dict[str, Any]:
        """Imports a YAML file of nodes and edges to upsert or delete (see import_items); with ``delete``, the file goes afterwards."""
        return self.import_items(read_bundle(self.files, path, delete=delete))

    @_tidy
    def import_items(self, items: list[dict[str, Any]]) -> dict[str, Any]:
        """Upserts and deletes nodes, then edges; all of it is published, or nothing if an edge lacks an end.

        Texts can be searched by then. Vectors that the cache lacks are made afterwards and published with a version of
        their own; ``vectors`` counts the contents that got one and those that didn't.
        """
        validate_bundle(self.ontology, items)
        result, touched = self._write(lambda: self._import(items))
        result["vectors"] = self._embed_index(touched)
        return result | {"version": self.snapshots.current}

    def _import(self, items: list[dict[str, Any]]) -> tuple[dict[str, Any], list[str]]:
        """Counts, and the node types that have changed."""
        now = _now()
        groups: dict[tuple[str, str], list[dict[str, Any]]] = defaultdict(list)
        for item in items:
            groups[item["type"], "delete" if item.get("action") == "delete" else "upsert"].append(item)
        nodes = {n: self.nodes(n) for n in self.ontology.nodes}
        edges = {e: self.edges(e) for e in self.ontology.edges}
        counts: dict[str, Any] = {"nodes": {"upserted": {}, "deleted": {}}, "edges": {"upserted": {}, "deleted": {}}}
        lost_edges: dict[str, list[DataFrame]] = defaultdict(list)
        touched: dict[str, tuple[DataFrame, DataFrame]] = {}
        indexed = 0

        def merged(version: Version, table: str, keys: list[str], before: DataFrame, upserts: DataFrame | None, deletes: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
            """Rows that a table gets, ids of all rows that change or go, and ids of those that go by key."""
            top = version.top(table, lambda: merge.highest_id(before))
            rows = before.limit(0)
            if upserts is not None:
                rows = cut(merge.changes(before, upserts, keys, now=now, top=F.lit(top).cast("long"), supplied="__supplied"))
                version.raise_top(table, merge.highest_id(rows))
            if deletes is None:
                return rows, rows.select("__id"), None
            gone = cut(merge.matching(before, deletes, keys).select("__id").unionByName(merge.matching(rows, deletes, keys).select("__id")).distinct())
            return rows.join(gone, "__id", "left_anti").select(*before.columns), rows.select("__id").unionByName(gone).distinct(), gone

        with self.snapshots.version() as version:
            for name, n in self.ontology.nodes.items():
                upserts, deletes = groups.get((name, "upsert")), groups.get((name, "delete"))
                if not (upserts or deletes):
                    continue
                keys = list(n.identity)
                new = merge.last_wins(self._batch(upserts, n.columns), keys, ["__pos"]).drop("__pos") if upserts else None
                old = self._batch(deletes, {k: n.columns[k] for k in keys}) if deletes else None
                rows, ids, gone = merged(version, n.table, keys, nodes[name], new, old)
                for e in self.ontology.edges.values() if gone is not None else ():
                    if name in (e.source, e.target):
                        lost_edges[e.name].append(merge.ending_in(edges[e.name], gone, source=e.source == name, target=e.target == name))
                for action, batch in (("upserted", upserts), ("deleted", deletes)):
                    if batch:
                        counts["nodes"][action][name] = len(batch)
                ids = ids if gone is None else cut(ids)
                touched[name] = version.change(n.table, rows, "__id", ids), ids
                nodes[name] = version.read(self.spark, n.table, n.struct)
            missing: list[str] = []
            for name, e in self.ontology.edges.items():
                batches = {action: batch for action in ("upsert", "delete") if (batch := groups.get((name, action)))}
                if not (batches or lost_edges[name]):
                    continue
                lost = cut(reduce(DataFrame.unionByName, lost_edges[name]).distinct()) if lost_edges[name] else None
                before = edges[name] if lost is None else edges[name].join(lost, "__id", "left_anti").select(*edges[name].columns)
                keys, said = ["__from_id", "__to_id"], {action: self._edge_batch(batch, e, nodes) for action, batch in batches.items()}
                for action, batch in batches.items():
                    counts["edges"]["upserted" if action == "upsert" else "deleted"][name] = len(batch)
                if "upsert" in said:
                    absent = said["upsert"].filter("__from_id is null or __to_id is null").select("__pos").orderBy("__pos").limit(20).collect()
                    missing += [f"{name}[{r[0]}]: {batches['upsert'][r[0]]['source']} -> {batches['upsert'][r[0]]['target']}" for r in absent]
                    said["upsert"] = merge.last_wins(said["upsert"].filter("__from_id is not null and __to_id is not null"), keys, ["__pos"]).drop("__pos")
                rows, ids, _ = merged(version, e.table, keys, before, said.get("upsert"), said["delete"].select(*keys) if "delete" in said else None)
                self._change_edges(version, e, rows, cut(ids if lost is None else ids.unionByName(lost)))
            if missing:
                raise ValidationError(f"Edges whose ends don't exist: {'; '.join(missing)}")
            if touched:
                indexed = self._index(version, touched, now)
        return {"status": "success", **counts, "indexed": indexed, "dumped": bool(version.written)}, list(touched)

    def _batch(self, items: list[dict[str, Any]], columns: dict[str, T.DataType]) -> DataFrame:
        """Items as rows: columns, __supplied (the names that an item has) and __pos."""
        fields = [T.StructField(k, t) for k, t in columns.items()] + [T.StructField("__supplied", T.ArrayType(T.StringType())), T.StructField("__pos", T.LongType())]
        rows = [(*(_value(x.get(k), t) for k, t in columns.items()), [k for k in columns if k in x], i) for i, x in enumerate(items)]
        return values(self.spark, rows, T.StructType(fields))

    def _edge_batch(self, items: list[dict[str, Any]], e: Any, nodes: dict[str, DataFrame]) -> DataFrame:
        ends = {"source": self.ontology.nodes[e.source], "target": self.ontology.nodes[e.target]}
        flat = [x | {f"__{side}_{k}": str(x[side][k]) for side, n in ends.items() for k in n.identity} for x in items]
        named = {f"__{side}_{k}": T.StringType() for side, n in ends.items() for k in n.identity}
        rows = self._batch(flat, e.columns | named)
        for side, into in _ENDS:
            fields = {k: f"__{side}_{k}" for k in ends[side].identity}
            # only the nodes that the batch names are moved to it
            named_here = [F.col(k).cast("string") == F.col(c) for k, c in fields.items()]
            known = nodes[ends[side].name].select("__id", *fields).join(rows.select(*fields.values()).distinct(), named_here, "left_semi")
            rows = merge.resolve(rows, known, fields, into)
        return rows.drop(*named)

    def _index(self, version: Version, changed: dict[str, tuple[DataFrame, DataFrame | None]], now: Column, *, from_cache: bool = False) -> int:
        """Writes index slices, postings and statistics of node types, and the cache.

        changed: by name, nodes to index and the ids that they take the place of; None makes the slices anew. Vectors come
        from the cache; with ``from_cache``, tokens too, and what the cache lacks stays null. Returns the number of new entries.
        """
        types = [self.ontology.node(name) for name in changed if self.ontology.node(name).searched]
        if not types:
            return 0
        cache = version.read(self.spark, CACHE_TABLE, CACHE_SCHEMA)
        own = [index.entries(changed[n.name][0], n.table, n.searched, size=self.config.chunk_size, overlap=self.config.chunk_overlap) for n in types]
        rows = cut(index.with_cache(reduce(DataFrame.unionByName, own), cache, compute_tokens=not from_cache, words=self.words))
        top = version.top(INDEX_TABLE, lambda: merge.highest_id(self.index(), "id"))
        rows = merge.assign_ids(rows.withColumn("__id", F.lit(None).cast("long")), ["source_table", "source_id", "source_field", "chunk_seq"], F.lit(top).cast("long"))
        rows = cut(rows.withColumn("created_at", now).withColumnRenamed("__id", "id").select(*INDEX_SCHEMA.names))
        version.raise_top(INDEX_TABLE, merge.highest_id(rows, "id"))
        for n in types:
            mine, ids = rows.filter(F.col("source_table") == n.table), changed[n.name][1]
            slices = [f"{table}.{n.table}" for table in (INDEX_TABLE, POSTINGS_TABLE, STATS_TABLE)]
            if ids is None:
                for table, made in zip(slices, (mine, index.stored_postings(mine), index.stats(mine)), strict=True):
                    version.write(table, made)
                continue
            sources = ids.select(F.col("__id").alias("source_id"))
            old = cut(version.read(self.spark, slices[0], INDEX_SCHEMA).join(sources, "source_id", "left_semi").select(*INDEX_SCHEMA.names))
            version.change(slices[0], mine, "source_id", sources)
            version.change(slices[1], index.stored_postings(mine), "id", old.select("id"), index.by_term)
            version.change(slices[2], index.stats_change(old, mine), layout=index.summed)
        if not from_cache:
            self._change_cache(version, rows.select("content_hash", "fts_content", "vector"), now)
        return rows.count()

    def _change_cache(self, version: Version, new: DataFrame, now: Column) -> None:
        hashes = new.select("content_hash").distinct()
        held = version.read(self.spark, CACHE_TABLE, CACHE_SCHEMA)
        version.change(CACHE_TABLE, index.merge_cache(held.join(hashes, "content_hash", "left_semi").select(*held.columns), new, now), "content_hash", hashes)

    def _embed_index(self, names: list[str]) -> dict[str, int]:
        """Embeds what the index slices of some node types lack and publishes it. The provider works while other writers
        may publish; its vectors go to whatever entries have those contents by then.
        """
        searched = [n for n in names if self.ontology.node(n).searched]
        with self.snapshots.pinned():
            lacking = [self.index(n).filter("vector is null").select("content_hash", "content", "vector") for n in searched]
            if not lacking:
                return {"success": 0, "failed": 0}
            new = cut(index.embed_missing(reduce(DataFrame.unionByName, lacking), self.embedder))
        n, done = new.agg(F.count(F.lit(1)), F.count("vector")).first()
        if done:
            self._write(lambda: self._publish_vectors(searched, new.filter("vector is not null").select("content_hash", "vector")))
        return {"success": done, "failed": n - done}

    def _publish_vectors(self, names: list[str], new: DataFrame) -> None:
        with self.snapshots.version() as version:
            for n in names:
                held = self.index(n)
                sources = cut(held.filter("vector is null").join(new, "content_hash", "left_semi").select("source_id").distinct())
                if not sources.isEmpty():
                    rows = held.join(sources, "source_id", "left_semi").select(*INDEX_SCHEMA.names)
                    version.change(f"{INDEX_TABLE}.{self.ontology.node(n).table}", index.with_vectors(rows, new), "source_id", sources)
            self._change_cache(version, new, _now())

    @_tidy
    def _build(self, node_type: str | None, from_cache: bool) -> int:
        names = [self.ontology.node(n).name for n in ([node_type] if node_type else self.ontology.nodes)]

        def change() -> int:
            with self.snapshots.version() as version:
                return self._index(version, {n: (self.nodes(n), None) for n in names}, _now(), from_cache=from_cache)

        n = self._write(change)
        if not from_cache:
            self._embed_index(names)
        return n

    def build_index(self, node_type: str | None = None) -> int:
        """Indexes all nodes, or those of a type, anew; chunks that are gone go. Returns the number of entries."""
        return self._build(node_type, False)

    rebuild_index = build_index

    def rebuild_index_from_cache(self, node_type: str | None = None) -> int:
        """The same with tokens and vectors from the cache alone; what it lacks stays null."""
        return self._build(node_type, True)

    @_tidy
    def embed(self, texts: list[str]) -> list[list[float]]:
        """Vectors of texts in their order, from the cache where it has them; new ones go there."""
        if not texts:
            return []
        hashes = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        rows = self.spark.createDataFrame(list(dict(zip(hashes, texts, strict=True)).items()), "content_hash string, content string")
        with self.snapshots.pinned():
            rows = index.with_cache(rows, self.cache(), words=self.words)
        new = cut(index.embed_missing(rows, self.embedder))
        if failed := new.filter("error is not null").select("error").first():
            raise KnowledgeBaseError(f"Embedding failed: {failed[0]}")
        rows = cut(index.with_vectors(rows, new))
        fresh = rows.select("content_hash", "fts_content", "vector")

        def change() -> None:
            with self.snapshots.version() as version:
                self._change_cache(version, fresh, _now())

        self._write(change)
        held = {r[0]: r[1] for r in rows.select("content_hash", "vector").collect()}  # the caller's own list
        return [held[h] for h in hashes]

    def embed_single(self, text: str) -> list[float]:
        return self.embed([text])[0]

    def clean_cache(self, expire_days: int = 30) -> int:
        def change() -> int:
            before = self.cache()
            kept = index.expire(before, expire_days, _now())
            self.snapshots.publish({CACHE_TABLE: kept})
            return before.count() - kept.count()

        return self._write(change)

    # files

    def dump_node(self, node_type: str, folder: str, *, by_date: bool = True) -> int:
        return dump(self.nodes(node_type), f"{folder}/nodes/{self.ontology.node(node_type).table}", by_date=by_date, rows_per_file=self.config.max_rows_per_file)

    def dump_edge(self, name: str, folder: str, *, by_date: bool = True) -> int:
        return dump(self.edges(name), f"{folder}/edges/{name.lower()}", by_date=by_date, rows_per_file=self.config.max_rows_per_file)

    def sync_node(self, node_type: str, folder: str) -> dict[str, int]:
        """Merges a type's files into its table, indexes it anew, and writes the files again."""
        return {"loaded": self.load_node(node_type, folder), "indexed": self.build_index(node_type), "dumped": self.dump_node(node_type, folder)}

    def sync_edge(self, name: str, folder: str) -> dict[str, int]:
        return {"loaded": self.load_edge(name, folder), "dumped": self.dump_edge(name, folder)}

    def load_node(self, node_type: str, folder: str) -> int:
        """Merges JSON lines by identity; rows without id get one."""
        n = self.ontology.node(node_type)
        return self._load(n, read_jsonl(self.spark, f"{folder}/nodes/{n.table}", n.struct), list(n.identity))

    def load_edge(self, name: str, folder: str) -> int:
        if name not in self.ontology.edges:
            raise ValueError(f"Unknown edge type: {name}")
        e = self.ontology.edges[name]
        return self._load(e, read_jsonl(self.spark, f"{folder}/edges/{name.lower()}", e.struct), ["__from_id", "__to_id"])

    def _load(self, kind: NodeType | EdgeType, rows: DataFrame, keys: list[str]) -> int:
        now = _now()

        def change() -> None:
            with self.snapshots.version() as version:
                held = version.read(self.spark, kind.table, rows.schema)
                merged = merge.loaded(held, rows, keys, now, F.lit(version.top(kind.table, lambda: merge.highest_id(held))).cast("long"))
                if isinstance(kind, EdgeType):
                    self._write_edges(version, kind, merged)
                else:
                    version.write(kind.table, merged)
                version.raise_top(kind.table, merge.highest_id(version.read(self.spark, kind.table, rows.schema)))

        n = rows.count()
        self._write(change)
        return n

    def save_cache(self, path: str) -> int:
        self.cache().write.mode("overwrite").parquet(path)
        return self.cache().count()

    def load_cache(self, path: str) -> int:
        """Entries of a saved cache replace those of the same content; a folder that isn't there changes nothing."""
        if not self.files.exists(path):
            return 0
        new = self.spark.read.schema(CACHE_SCHEMA).parquet(path).withColumn("__new", F.lit(1))
        self._write(lambda: self.snapshots.publish({CACHE_TABLE: merge.last_wins(self.cache().withColumn("__new", F.lit(0)).unionByName(new), ["content_hash"], ["__new"]).drop("__new")}))
        return self.cache().count()

    # search

    def rrf_k(self) -> int:
        """k for the number of indexed documents, which each version of the index keeps."""
        return self.config.rrf.of(self.index_stats().agg(F.coalesce(F.sum("documents"), F.lit(0).cast("long"))).first()[0])

    refresh_k = rrf_k

    def _in(self, node_type: str | None) -> Column | None:
        return F.col("source_table") == self.ontology.node(node_type).table if node_type else None

    def _query_vector(self, query: str) -> Column | None:
        try:
            v = self.embedder([query])[0]
        except Exception:  # noqa: BLE001  without a query vector there is nothing to search by
            return None
        return literal(v) if len(v) == self.config.embedding_dim else None

    def _checked(self, query: str, node_type: str | None, limit: int) -> bool:
        if limit < 0:
            raise ValueError("limit must not be negative")
        if node_type:
            self.ontology.node(node_type)
        return bool(query and query.strip() and limit)

    def _text_scores(self, query: str, keep: Column | None) -> DataFrame:
        terms = self.spark.range(1).select(tokens(F.lit(query), self.words)).first()[0]
        n, words = self.index_stats().agg(F.coalesce(F.sum("chunks"), F.lit(0).cast("long")), F.coalesce(F.sum("tokens"), F.lit(0).cast("long"))).first()
        return search.bm25_postings(self.postings(), terms, n, words / n if words else 1.0, keep)

    def _shape(self, best: DataFrame, k: int | None) -> list[dict[str, Any]]:
        rows = search.with_content(best, self.index())
        out = []
        for i, r in enumerate(rows.orderBy(F.desc("score"), "id").collect(), 1):  # limit rows
            d = {c: r[c] for c in ("source_table", "source_id", "source_field", "chunk_seq", "content", "score")}
            out.append(d | ({"_meta": {"rank": i, "rrf_k": k, "auto_k": self.config.rrf.auto_k, "strategy": self.config.rrf.strategy}} if k else {}))
        return out

    @_one_version
    def vector_search(self, query: str, *, node_type: str | None = None, limit: int = 10) -> list[dict[str, Any]]:
        """Chunks whose vectors are nearest to the query's by cosine, best first, of one node type or of all."""
        if not self._checked(query, node_type, limit) or (v := self._query_vector(query)) is None:
            return []
        return self._shape(search.top(search.vector_scores(self.index(node_type), v).select("id", "score"), limit), None)

    @_one_version
    def fts_search(self, query: str, *, node_type: str | None = None, limit: int = 10) -> list[dict[str, Any]]:
        """Chunks that have any of the query's words, best by BM25 first, of one node type or of all."""
        if not self._checked(query, node_type, limit):
            return []
        return self._shape(search.top(self._text_scores(query, self._in(node_type)).select("id", "score"), limit), None)

    @_one_version
    def search(self, query: str, *, node_type: str | None = None, limit: int = 10, alpha: float = 0.5) -> list[dict[str, Any]]:
        """Vector and full-text search fused by ranks; ``alpha`` is the weight of vectors, 0 to 1. Results tell where a chunk comes from and what it says."""
        if not self._checked(query, node_type, limit) or (v := self._query_vector(query)) is None:
            return []
        keep, k = self._in(node_type), self.rrf_k()
        return self._shape(search.fuse(search.vector_scores(self.index(node_type), v), self._text_scores(query, keep), limit=limit, k=k, alpha=alpha), k)

    @_one_version
    def get_source_record(self, source_table: str, source_id: int) -> dict[str, Any] | None:
        """The node that a search result comes from, by its source_table and source_id; None if it is gone."""
        name = self.ontology.by_table(table_name(source_table))
        if name is None:
            raise ValueError(f"Unknown table: {source_table}")
        row = search.record(self.nodes(name), source_id).collect()
        return row[0].asDict() if row else None

    @_one_version
    def query_raw_sql(self, sql: str) -> list[dict[str, Any]]:
        """Rows of one query over the tables of the knowledge base, and no others."""
        return sqlgate.rows_of(sqlgate.gated_sql(self.spark, sql, self.tables()))

    # graph

    def resolve(self, node_type: str, node_id: int | str) -> int | None:
        """The id of a node by its id or its first identity field; None if there is no such node."""
        try:
            return self._start(node_type, node_id).first()["id"]
        except NodeNotFoundError:
            return None

    def _start(self, node_type: str, node_id: int | str) -> DataFrame:
        """type and id of an existing node, by id or by its first identity field."""
        n = self.ontology.node(node_type)
        by = F.col("__id") == node_id if isinstance(node_id, int) else F.col(n.identity[0]).cast("string") == node_id
        row = self.nodes(node_type).filter(by).select("__id").limit(1).collect()
        if not row:
            raise NodeNotFoundError(node_type, node_id)
        return values(self.spark, [(node_type, row[0][0])], "type string, id long")

    def _node_rows(self, keys: list[tuple[str, int]]) -> dict[tuple[str, int], dict[str, Any]]:
        out = {}
        for kind in {k for k, _ in keys}:
            ids = [i for k, i in keys if k == kind]
            out |= {(kind, r["__id"]): r.asDict() for r in self.nodes(kind).filter(F.col("__id").isin(ids)).collect()}
        return out

    def _edge_rows(self, keys: list[tuple[str, int]]) -> dict[tuple[str, int], dict[str, Any]]:
        out = {}
        for kind in {k for k, _ in keys}:
            ids = [i for k, i in keys if k == kind]
            out |= {(kind, r["__id"]): r.asDict() for r in self.edges(kind).filter(F.col("__id").isin(ids)).collect()}
        return out

    @_one_version
    def get_neighbors(self, node_type: str, node_id: int | str, *, edge_types: list[str] | None = None, direction: str = "both", limit: int = 100) -> dict[str, Any]:
        """A node, by id or first identity field, its neighbors over the given edge types and direction (out, in or both) with the edges between, and counts; ``limit`` counts for each edge type."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        graph.arrows(self.links(), direction)
        start = self._start(node_type, node_id)
        me = start.first()
        steps = graph.neighbors(self.links(), start, direction=direction, edge_types=edge_types, limit=limit).collect()  # limit rows of each edge type
        steps.sort(key=lambda r: (r["direction"] != "out", r["edge_type"], r["edge_id"]))
        nodes = self._node_rows([(me[0], me[1]), *((r["dst_type"], r["dst_id"]) for r in steps)])
        edges = self._edge_rows([(r["edge_type"], r["edge_id"]) for r in steps])
        counts: dict[str, int] = {}
        for r in steps:
            counts[r["edge_type"]] = counts.get(r["edge_type"], 0) + 1
        found = self._neighbors(steps, nodes, edges, direction)
        return {"node": nodes.get((me[0], me[1]), {}), "neighbors": found, "stats": {"total_count": len(found), "by_edge_type": counts}}

    def _neighbors(self, steps: list[Any], nodes: dict[tuple[str, int], Any], edges: dict[tuple[str, int], Any], direction: str) -> list[dict[str, Any]]:
        """Steps of one node as neighbors; in both directions, those to the same node are one."""
        by: dict[tuple[str, int], list[Any]] = defaultdict(list)
        for r in steps:
            by[(r["dst_type"], r["dst_id"]) if direction == "both" else (len(by), 0)].append(r)
        found = []
        for hits in by.values():
            r = hits[0]
            d = {"edge_type": r["edge_type"], "node": nodes.get((r["dst_type"], r["dst_id"]), {}), "node_type": r["dst_type"]}
            one = {"direction": r["direction"], "edge": edges.get((r["edge_type"], r["edge_id"]), {})}
            many = {"directions": list(dict.fromkeys(h["direction"] for h in hits)), "edges": [edges.get((h["edge_type"], h["edge_id"]), {}) for h in hits]}
            found.append(d | (one if len(hits) == 1 else many))
        return found

    @_one_version
    def traverse(self, node_type: str, node_id: int | str, *, edge_types: list[str] | None = None, direction: str = "out", max_depth: int = 3, limit: int = 1000, return_paths: bool = True) -> list[dict[str, Any]]:
        """What can be reached from a node in max_depth steps: paths, or with return_paths false the nodes with their least depth and number of shortest paths."""
        if limit < 0:
            raise ValueError("limit must not be negative")
        if max_depth < 1:
            raise ValueError("max_depth must be at least 1")
        start = self._start(node_type, node_id)
        if return_paths:
            return [{"path": p, "depth": r["depth"], "end_node": p[-1]["node"]} for r, p in self._told(graph.paths(self.links(), start, direction=direction, edge_types=edge_types, max_depth=max_depth, limit=limit))]
        rows = graph.traverse_nodes(self.links(), start, direction=direction, edge_types=edge_types, max_depth=max_depth, enough=limit).orderBy("min_depth", "type", "id").limit(limit).collect()
        nodes = self._node_rows([(r["type"], r["id"]) for r in rows])
        return [{"node": nodes.get((r["type"], r["id"]), {}), "node_type": r["type"], "min_depth": r["min_depth"], "paths_count": r["paths_count"]} for r in rows]

    def _told(self, found: DataFrame):
        """Path rows with paths of alternating nodes and edges."""
        rows = found.collect()  # limit rows
        split = lambda x: (x.rpartition(":")[0], int(x.rpartition(":")[2]))
        nodes = self._node_rows(list({split(x) for r in rows for x in r["nodes"]}))
        edges = self._edge_rows(list({split(x) for r in rows for x in r["edges"]}))
        for r in rows:
            path: list[dict[str, Any]] = []
            for i, x in enumerate(r["nodes"]):
                if i:
                    key = split(r["edges"][i - 1])
                    path.append({"edge_type": key[0], "edge": edges.get(key, {})})
                path.append({"node": nodes.get(split(x), {}), "node_type": split(x)[0]})
            yield r, path

    @_one_version
    def extract_subgraph(self, node_type: str, node_id: int | str, *, edge_types: list[str] | None = None, max_depth: int = 2, node_limit: int = 100, edge_limit: int = 200) -> dict[str, Any]:
        """The nodes within max_depth steps of a node, nearest first, and the edges between them, up to both limits; ``truncated`` tells whether a limit was met."""
        start = self._start(node_type, node_id)
        nodes, edges = graph.subgraph(self.links(), start, edge_types=edge_types, max_depth=max_depth, node_limit=node_limit, edge_limit=edge_limit)
        nodes, edges = nodes.collect(), edges.collect()  # bounded by the limits
        data = self._node_rows([(r["type"], r["id"]) for r in nodes])
        told = self._edge_rows([(r["edge_type"], r["edge_id"]) for r in edges])
        rows = [{"type": r["type"], **data.get((r["type"], r["id"]), {})} for r in sorted(nodes, key=lambda r: (r["min_depth"], r["type"], r["id"]))]
        stats = {"node_count": len(nodes), "edge_count": len(edges), "depth_reached": max(r["min_depth"] for r in nodes), "truncated": len(nodes) >= node_limit or len(edges) >= edge_limit}
        return {"center_node": rows[0], "nodes": rows[1:], "edges": [{"type": r["edge_type"], **told.get((r["edge_type"], r["edge_id"]), {})} for r in edges], "stats": stats}

    @_one_version
    def find_paths(self, from_type: str, from_id: int | str, to_type: str, to_id: int | str, *, edge_types: list[str] | None = None, max_depth: int = 5, limit: int = 10) -> list[dict[str, Any]]:
        """Paths between two nodes over edges of either direction, shortest first, at most ``limit`` and of max_depth steps."""
        if max_depth < 1 or limit < 0:
            raise ValueError("max_depth must be at least 1 and limit not negative")
        found = graph.paths(self.links(), self._start(from_type, from_id), direction="both", edge_types=edge_types, max_depth=max_depth, to=self._start(to_type, to_id), limit=limit)
        return [{"path": p, "length": r["depth"], "node_types": [x["node_type"] for x in p if "node" in x]} for r, p in self._told(found)]

    @_one_version
    def graph_search(self, query: str, *, node_type: str | None = None, edge_types: list[str] | None = None, direction: str = "both", traverse_depth: int = 1, search_limit: int = 5, neighbor_limit: int = 10, alpha: float = 0.5) -> list[dict[str, Any]]:
        """Hybrid search, and around each hit the nodes within traverse_depth hops; a hop of all hits is one join (see graph.context)."""
        graph.arrows(self.links(), direction)
        hits = [(self.ontology.by_table(h["source_table"]), h) for h in self.search(query, node_type=node_type, limit=search_limit, alpha=alpha)]
        seeds = self._node_rows(list({(k, h["source_id"]) for k, h in hits if k}))
        hits = [(k, h) for k, h in hits if (k, h["source_id"]) in seeds]
        around: dict[tuple[str, int], list[dict[str, Any]]] = defaultdict(list)
        if hits and traverse_depth > 0:
            start = values(self.spark, sorted(seeds), "type string, id long")
            found = graph.context(self.links(), start, direction=direction, edge_types=edge_types, max_depth=traverse_depth, limit=neighbor_limit).collect()  # limit rows of each hit, hop and edge type
            nodes, edges = self._node_rows(list({(r["type"], r["id"]) for r in found})), self._edge_rows(list({(r["edge_type"], r["edge_id"]) for r in found}))
            for r in sorted(found, key=lambda r: (r["depth"], r["direction"] != "out", r["edge_type"], r["edge_id"])):
                way = "both" if direction == "both" and r["n_edges"] > 1 else r["direction"]
                around[r["seed_type"], r["seed_id"]].append({"edge_type": r["edge_type"], "direction": way, "edge": edges.get((r["edge_type"], r["edge_id"]), {}), "node_type": r["type"], "node": nodes.get((r["type"], r["id"]), {})})
        return [{"seed": {"node_type": k, "node": seeds[k, h["source_id"]], "score": h["score"], "source_field": h["source_field"], "content": h["content"]}, "context": around[k, h["source_id"]]} for k, h in hits]

    # documents about the knowledge base

    def get_bundle_schema(self) -> dict[str, Any]:
        return bundle_schema(self.ontology)

    def get_info(self) -> str:
        """Markdown: usage, import schema, tables, relations, and a Mermaid graph."""
        schema = self.get_bundle_schema()
        lines = ["# Knowledge base", "", self.config.usage_instructions or "", "", "## Import schema", "", "```json", json.dumps(schema["full_bundle_schema"], ensure_ascii=False, indent=2), "```", "", "```yaml", schema["example_yaml"], "```", "", "## Tables", ""]
        for name, struct in [(n.table, n.struct) for n in self.ontology.nodes.values()] + [(e.table, e.struct) for e in self.ontology.edges.values()] + [(INDEX_TABLE, INDEX_SCHEMA), (CACHE_TABLE, CACHE_SCHEMA)]:
            lines += ["```sql", f"CREATE TABLE {name} (" + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in struct) + ")", "```", ""]
        lines += ["## Relations", "", "| edge | from | to | cardinality |", "|-|-|-|-|", *(f"| {e.name} | {e.source} | {e.target} | {e.cardinality} |" for e in self.ontology.edges.values()), "", "```mermaid", "graph LR", *(f"  {e.source} -->|{e.name}| {e.target}" for e in self.ontology.edges.values()), "```"]
        return "\n".join(lines)


__all__ = ["Engine", "content_hash", "hashing_embedder", "segment"]
