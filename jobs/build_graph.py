"""Builds the nodes and edges of a knowledge graph from relational tables, and sets apart edges whose ends don't exist.

    python -m jobs.build_graph --source TABLES --output GRAPH [--config FILE]

Under the output:

- edges, partitioned by status (valid or dangling) and edge_type: from_id, to_id and how many source rows say so;
- nodes, partitioned by node_type: id, name, and the valid edges that leave it (n_out) and reach it (n_in).

A run replaces what the one before has written; the same tables give the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command, log, settings
from loreweave.errors import ConfigurationError

CONFIG = Path(__file__).with_name("build_graph.yaml")
NODES = "id long, name string, n_out long, n_in long, node_type string"
EDGES = "from_id long, to_id long, n_rows long, status string, edge_type string"


def read_settings(path: str | Path) -> dict[str, Any]:
    s = settings(path, {"nodes": {}, "edges": {}})
    for name, e in s["edges"].items():
        if lost := {e[end][0] for end in ("from", "to")} - set(s["nodes"]):
            raise ConfigurationError(f"{path}: edge {name} ends in {sorted(lost)}, which is no node type")
    return s


@contextmanager
def _changed(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _nodes(spark: SparkSession, source: str, n: dict[str, str]) -> DataFrame:
    """id and name of a node type: of rows that repeat an id, the least name; without id there is no node."""
    rows = spark.read.parquet(f"{source}/{n['table']}.parquet")
    rows = rows.filter(n["where"]) if n.get("where") else rows
    return rows.select(F.col(n["id"]).cast("long").alias("id"), F.col(n["name"]).cast("string").alias("name")).filter("id is not null").groupBy("id").agg(F.min("name").alias("name"))


def _edges(spark: SparkSession, source: str, e: dict[str, Any], nodes: dict[str, DataFrame]) -> DataFrame:
    """Distinct edges of a type with their status. A missing id dangles like one that no node has."""
    rows = spark.read.parquet(f"{source}/{e['table']}.parquet")
    rows = rows.select(*[F.col(e[end][1]).cast("long").alias(f"{end}_id") for end in ("from", "to")]).groupBy("from_id", "to_id").agg(F.count(F.lit(1)).alias("n_rows"))
    for end in ("to", "from"):  # a last join that deals edges out by from_id leaves them in the order of the files
        there = nodes[e[end][0]].select(F.col("id").alias(f"{end}_id"), F.lit(True).alias(f"has_{end}"))
        rows = rows.join(there, f"{end}_id", "left")
    return rows.withColumn("status", F.when(F.col("has_from") & F.col("has_to"), F.lit("valid")).otherwise(F.lit("dangling"))).select("from_id", "to_id", "n_rows", "status")


def build_graph(spark: SparkSession, source: str, output: str, s: dict[str, Any] | None = None) -> DataFrame:
    """Builds the graph that the settings describe from ``source``/TABLE.parquet, and returns all of it as rows.

    Rows: part (valid, dangling or node), kind (edge or node type), id and other_id (the ends of an edge), name, n (rows of an
    edge, edges that leave a node) and n_in. Node ids are cast to long; a row without one is no node.
    """
    s = s or read_settings(CONFIG)
    source, output = source.rstrip("/"), output.rstrip("/")
    nodes = {k: _nodes(spark, source, n) for k, n in s["nodes"].items()}

    def write(rows: DataFrame, name: str, schema: str, *by: str) -> DataFrame:
        """Sorted ids within a file let a search for one skip row groups.

        Rows are written where their last join left them, by a sort of ids alone: a task has one type, so its open files are few.
        """
        first = next(c for c in rows.columns if c not in by)
        with _changed(spark, "spark.sql.maxConcurrentOutputFileWriters", "8"):
            rows.sortWithinPartitions(first).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(*by).parquet(f"{output}/{name}")
        out = spark.read.schema(schema).parquet(f"{output}/{name}")
        for r in out.groupBy(*by).count().orderBy(*by).collect():  # a row for each type
            log.info("%s %s: %d rows written", name, "/".join(r[:-1]), r["count"])
        return out

    log.info("reading %s of %s", ", ".join(sorted({x["table"] for k in ("nodes", "edges") for x in s[k].values()})), source)
    empty = spark.createDataFrame([], EDGES)
    told = [_edges(spark, source, e, nodes).withColumn("edge_type", F.lit(k)) for k, e in s["edges"].items()]
    edges = write(reduce(DataFrame.unionByName, told, empty), "edges", EDGES, "status", "edge_type")

    def degree(kind: str, end: str) -> DataFrame:
        types = [k for k, e in s["edges"].items() if e[end][0] == kind]
        return edges.filter((F.col("status") == "valid") & F.col("edge_type").isin(types)).groupBy(F.col(f"{end}_id").alias("id")).agg(F.count(F.lit(1)).alias("n_out" if end == "from" else "n_in"))

    zero = F.lit(0).cast("long")
    counted = [n.join(degree(k, "from"), "id", "left").join(degree(k, "to"), "id", "left").select("id", "name", F.coalesce("n_out", zero).alias("n_out"), F.coalesce("n_in", zero).alias("n_in"), F.lit(k).alias("node_type")) for k, n in nodes.items()]
    told_nodes = write(reduce(DataFrame.unionByName, counted, spark.createDataFrame([], NODES)), "nodes", NODES, "node_type")
    none = F.lit(None)
    return edges.select(F.col("status").alias("part"), F.col("edge_type").alias("kind"), F.col("from_id").alias("id"), F.col("to_id").alias("other_id"), none.cast("string").alias("name"), F.col("n_rows").alias("n"), none.cast("long").alias("n_in")).unionByName(
        told_nodes.select(F.lit("node").alias("part"), F.col("node_type").alias("kind"), "id", none.cast("long").alias("other_id"), "name", F.col("n_out").alias("n"), "n_in")
    )


def main(argv: Sequence[str] | None = None) -> int:
    return command(__doc__, build_graph, read_settings, ("source", "output"), CONFIG, argv)


if __name__ == "__main__":
    sys.exit(main())
