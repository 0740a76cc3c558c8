"""What the corpus operators share: inputs, tables in the shared folder, and packed chunks of documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.shared import shared_folder

#: A null id sorts behind all others.
NULL_ID = (1 << 63) - 1

CHUNK_SCHEMA = "chunk_id long, doc_ids array<long>, sizes array<int>, data binary"


def owned_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; a block of owned_tables() learns of it."""
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if _OWNED:
        _OWNED[-1].append(path)
    return path


def materialise(df: DataFrame, label: str, row_group_mb: int = 32) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back.

    The rows survive lost executors, and the lineage is cut.
    """
    spark = df.sparkSession
    path = owned_path(spark, label)
    df.write.option("compression", "zstd").option("parquet.block.size", row_group_mb << 20).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Innermost last: lists of the tables written in a block of owned_tables().
_OWNED: list[list[str]] = []


@contextmanager
def owned_tables() -> Iterator[list[str]]:
    """Collects the paths of the tables that materialise() writes meanwhile, so that their user can remove them."""
    _OWNED.append([])
    try:
        yield _OWNED[-1]
    finally:
        _OWNED.pop()


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Removes tables in the shared folder by the file system that their path names."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def tables_read(df: DataFrame) -> list[str]:
    """The folders of the files that df reads."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    files = [leaves.apply(i) for i in range(leaves.size())]
    return [x.relation().location().rootPaths().mkString(",") for x in files if x.getClass().getSimpleName() == "LogicalRelation"]


def with_row(df: DataFrame, schema: str) -> T.StructType:
    """schema with the column row: all columns of df as a struct."""
    return T.StructType([*T._parse_datatype_string(schema).fields, T.StructField("row", df.schema)])


def row_struct(df: DataFrame) -> F.Column:
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row")


def documents(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, as doc_id and text; other columns may have any name."""
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """df through fn, a batch of rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = fn(batch)
            if out is not None and out.num_rows:
                yield out

    return df.mapInArrow(run, schema)


def text_slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """First place and end of runs of texts of about so many bytes; a longer text is one of its own."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    lo = 0
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some texts, null as empty, and where each begins, without Python strings."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.empty(0, np.uint8)
    return raw, at - at[0]


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows, sorted by their first columns, ``keys`` numbers, in tables of whole groups, and where each group begins, and the end."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None

    def key_of(t: pa.Table | pa.RecordBatch) -> np.ndarray:
        return np.stack([np.asarray(t.column(i)) for i in range(keys)], 1)

    def whole() -> tuple[pa.Table, np.ndarray]:
        t = pa.Table.from_batches(held)
        key = key_of(t)
        return t, np.append(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]).any(axis=1)))), len(key))

    for batch in batches:
        if not batch.num_rows:
            continue
        key = key_of(batch)
        other = np.flatnonzero((key != key[-1]).any(axis=1))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append(batch.slice(0, cut))
        if held and (cut or tuple(key[0]) != last):
            yield whole()
            held = []
        held.append(batch.slice(cut))
        last = tuple(key[-1])
    if held:
        yield whole()


def binary(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([np.ascontiguousarray(x).tobytes() for x in arrays], pa.binary())


def chunked(df: DataFrame, chunk_bytes: int, label: str) -> DataFrame:
    """doc_id and text packed to rows of about chunk_bytes, written to the shared folder.

    The bytes of a chunk's texts travel as one compressed string. A longer document has a chunk of its own. Null texts count as empty. A chunk is the unit that
    later steps exchange bit masks and ranges with, so that no step needs a Spark row per word or byte.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, n = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal n, held
            data = pa.compress(b"".join(texts), codec="zstd", asbytes=True)
            out = pa.RecordBatch.from_pydict(
                {"chunk_id": pa.array([base + n], pa.int64()), "doc_ids": pa.array([ids], pa.list_(pa.int64())), "sizes": pa.array([list(map(len, texts))], pa.list_(pa.int32())), "data": pa.array([data], pa.binary())}
            )
            n, held = n + 1, 0
            ids.clear()
            texts.clear()
            return out

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                t = (t or "").encode()
                if ids and held + len(t) > chunk_bytes:
                    yield flush()
                ids.append(i)
                texts.append(t)
                held += len(t) + 16
        if ids:
            yield flush()

    return materialise(df.mapInArrow(run, CHUNK_SCHEMA), label, 8)


def unpack_chunk(ids: pa.ListScalar, sizes: pa.ListScalar, data: pa.BinaryScalar) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one chunk: the order keys of its ids (null behind all), the bytes of all its texts, and len+1 offsets."""
    offsets = np.concatenate(([0], np.cumsum(sizes.values.to_numpy(zero_copy_only=False), dtype=np.int64)))
    raw = np.frombuffer(pa.decompress(data.as_buffer(), int(offsets[-1]), codec="zstd"), np.uint8)
    return ids.values.fill_null(NULL_ID).to_numpy(zero_copy_only=False), raw, offsets


def total_bytes(chunks: DataFrame) -> int:
    """UTF-8 bytes of all texts in a chunk table."""
    return chunks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0


def ids_out(ids: pa.Array) -> pa.Array:
    return ids.cast(pa.int64())


def crc32_id(col: str = "doc_id") -> F.Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(col).cast("string").cast("binary"))
