"""Tables in the shared folder that cut lineage between rounds of iterative operators."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loreweave.errors import ConfigurationError


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a temporary folder will do only if the driver is the only machine.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.match(r"local(\[[^,]*(,[^,]*)?\])?$", spark.sparkContext.master):
            raise ConfigurationError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = f"file://{tempfile.mkdtemp(prefix='loreweave-')}"
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def values(spark: SparkSession, rows: Sequence[Sequence[Any]], schema: T.StructType | str) -> DataFrame:
    """A few rows as a relation in the plan itself: collecting it runs no job, and joins know that it is small."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], to_arrow_schema(schema)), schema)


#: Of each thread, the tables that the block of temporary_tables() it is in has written.
_OWN = threading.local()


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what cut() writes meanwhile on this thread, so results must have been collected or written by
    then. Blocks within such a block leave that to it.
    """
    if getattr(_OWN, "paths", None) is not None:
        yield
        return
    _OWN.paths = []
    try:
        yield
    finally:
        paths, _OWN.paths = _OWN.paths, None
        for path in paths:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back; survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/kb-{uuid.uuid4().hex}"
    if getattr(_OWN, "paths", None) is not None:
        _OWN.paths.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
