"""Keeps a full-text index of a growing folder of documents.

    python -m jobs.index_documents --source DOCUMENTS --output INDEX --checkpoint CHECKPOINT [--config FILE]

A file stream takes the Parquet files that no run before has taken, all that are there, and ends. Each batch of files writes one
partition, batch=N, of three tables under the output:

- documents: doc_id, the carried columns, n_chunks and n_tokens of each document of the batch;
- chunks: their index entries (chunk_seq, content, content_hash, fts_content, n_tokens);
- terms: of each term, by how much df (chunks that have it) and tf (its occurrences) change with the batch.

A document that comes again replaces the one before: readers take its last batch only (current()), and the batch takes its
earlier terms off. So the terms summed over all batches are those of the current documents, and no batch rewrites an
earlier one. A batch that is run again, as after a lost driver, overwrites its own partitions with the same rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobs.common import command, log, settings
from loreweave.functions.text import segment
from loreweave.operators.index import entries, word_counts
from loreweave.operators.merge import last_wins
from loreweave.shared import cut
from loreweave.sources.files import Files

CONFIG = Path(__file__).with_name("index_documents.yaml")


@dataclass(frozen=True)
class Settings:
    id: str = "doc_id"
    text: str = "text"
    carry: tuple[str, ...] = ("lang",)
    chunk_size: int = 800
    chunk_overlap: int = 100
    files_per_batch: int = 1000

    @classmethod
    def read(cls, path: str | Path) -> Settings:
        known = {k: getattr(cls, k) for k in cls.__dataclass_fields__}
        given = settings(path, known)
        return cls(**given | {"carry": tuple(given["carry"])})


def _latest(batch: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """One row of each id, the greatest by ``order``, rows without id left out.

    Ids alone are exchanged to learn which come more than once, and whole rows of those only.
    """
    known = batch.filter(F.col(key).isNotNull())
    often = cut(known.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select(key))
    if often.isEmpty():
        return known
    return known.join(often, key, "left_anti").unionByName(last_wins(known.join(often, key, "left_semi"), [key], list(order)))


class Index:
    """The tables of an index folder, as they stand."""

    def __init__(self, spark: SparkSession, output: str, fields: list[T.StructField]) -> None:
        self.spark, self.output = spark, output.rstrip("/")
        carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        also = f", {carried}" if carried else ""
        self.schemas = {
            "documents": f"doc_id long{also}, n_chunks long, n_tokens long, batch long",
            "chunks": f"doc_id long{also}, chunk_seq int, content string, content_hash string, fts_content string, n_tokens long, batch long",
            "terms": "term string, df long, tf long, batch long",
        }

    def all(self, table: str) -> DataFrame:
        """Rows of every batch; none before the first has been written."""
        path, schema = f"{self.output}/{table}", self.schemas[table]
        return self.spark.read.schema(schema).parquet(path) if Files(self.spark).exists(path) else self.spark.createDataFrame([], schema)

    def current(self, table: str, before: int | None = None, ids: DataFrame | None = None) -> DataFrame:
        """documents or chunks of each document's last batch: of batches before one, and of some ids, if they are given."""
        docs, rows = self.all("documents").select("doc_id", "batch"), self.all(table)
        if before is not None:
            docs, rows = docs.filter(F.col("batch") < before), rows.filter(F.col("batch") < before)
        if ids is not None:
            docs = docs.join(ids, "doc_id", "left_semi")
        last = docs.groupBy("doc_id").agg(F.max("batch").alias("batch"))
        return rows.join(last, ["doc_id", "batch"], "left_semi").select(*rows.columns)

    def terms(self) -> DataFrame:
        """term, df and tf over all current chunks."""
        return self.all("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df > 0")

    def write(self, table: str, rows: DataFrame, batch: int) -> DataFrame:
        """Replaces the partition of a batch and reads it again."""
        names = [f.name for f in T._parse_datatype_string(self.schemas[table]).fields]
        rows = rows.withColumn("batch", F.lit(batch).cast("long")).select(*names)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{self.output}/{table}")
        return self.all(table).filter(F.col("batch") == batch)


def _terms(chunks: DataFrame, sign: int) -> DataFrame:
    """What some chunks add to terms, or take off; a chunk's words are counted where it is."""
    return word_counts(chunks).groupBy("term").agg((F.count(F.lit(1)) * sign).alias("df"), (F.sum("tf") * sign).alias("tf"))


def add_batch(index: Index, batch: DataFrame, number: int, s: Settings) -> None:
    """Indexes one batch of rows with id, text and carried columns."""
    docs = batch.select(F.col(s.id).cast("long").alias("doc_id"), F.col(s.text).cast("string").alias("__text"), *s.carry)
    docs = _latest(docs, "doc_id", ["__text", *s.carry])
    rows = entries(docs, "documents", ["__text"], size=s.chunk_size, overlap=s.chunk_overlap, id_col="doc_id", carry=s.carry).withColumnRenamed("source_id", "doc_id")
    rows = rows.withColumn("fts_content", segment(F.col("content"))).withColumn("n_tokens", F.size(F.filter(F.split("fts_content", " "), lambda t: t != "")).cast("long"))
    carried = docs.select("doc_id", *s.carry)
    chunks = index.write("chunks", rows, number)
    sums = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.sum("n_tokens").alias("n_tokens"))
    zero = F.lit(0).cast("long")
    told = index.write("documents", carried.join(sums, "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", zero)).withColumn("n_tokens", F.coalesce("n_tokens", zero)), number)
    before = index.current("chunks", number, told.select("doc_id"))
    change = _terms(chunks, 1).unionByName(_terms(before, -1)).groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df <> 0 OR tf <> 0")
    index.write("terms", change, number)
    log.info("batch %d: %d rows read, %d documents, %d chunks and %d terms written", number, batch.count(), told.count(), chunks.count(), index.all("terms").filter(F.col("batch") == number).count())


def _stream(spark: SparkSession, source: str, schema: T.StructType, files: int) -> DataFrame:
    """The Parquet files of a folder or pattern, or one file, as a stream."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    if not Files(spark).is_file(source):
        return reader.parquet(source)
    folder, _, name = source.rstrip("/").rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder or "/")


def index_documents(spark: SparkSession, source: str, output: str, checkpoint: str, s: Settings | None = None) -> DataFrame:
    """Indexes the files of ``source`` (Parquet) that are new since the checkpoint, and returns the whole index as rows.

    Rows: part (chunk or term), key (content hash or term), doc_id, chunk_seq, n (tokens or df) and tf.
    Of rows that repeat an id within a batch, the one with the greatest text counts; rows without id have no place in
    the index. A null or empty text makes a document without chunks.
    """
    s = s or Settings()
    schema = spark.read.parquet(source).schema
    wanted = T.StructType([schema[c] for c in dict.fromkeys((s.id, s.text, *s.carry))])
    index = Index(spark, output, [schema[c] for c in s.carry])
    query = _stream(spark, source, wanted, s.files_per_batch).writeStream.foreachBatch(lambda batch, number: add_batch(index, batch, number, s)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    batches = len({p.batchId for p in query.recentProgress if p.numInputRows})
    log.info("%d batches of new files read from %s; index in %s", batches, source, output)
    return whole(index)


def whole(index: Index) -> DataFrame:
    none = F.lit(None)
    chunks = index.current("chunks").select(F.lit("chunk").alias("part"), F.col("content_hash").alias("key"), "doc_id", F.col("chunk_seq").cast("long").alias("chunk_seq"), F.col("n_tokens").alias("n"), none.cast("long").alias("tf"))
    terms = index.terms().select(F.lit("term").alias("part"), F.col("term").alias("key"), none.cast("long").alias("doc_id"), none.cast("long").alias("chunk_seq"), F.col("df").alias("n"), "tf")
    return reduce(DataFrame.unionByName, [chunks, terms])


def main(argv: Sequence[str] | None = None) -> int:
    return command(__doc__, index_documents, Settings.read, ("source", "output", "checkpoint"), CONFIG, argv)


if __name__ == "__main__":
    sys.exit(main())
