"""A corpus pipeline over the documents table: five stages, each written as Parquet and read again by the next.

Counted as part of the subpackage of corpus operators, and removed with it.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable
from functools import wraps
from threading import get_ident

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.bpe_codec import bpe_encode
from loreweave.llm.common import NULL_ID, materialise, owned_tables, remove, tables_read
from loreweave.llm.decontaminate import decontaminate
from loreweave.llm.exact_dedup import exact_dedup
from loreweave.llm.language_id import UNKNOWN, language_id
from loreweave.llm.near_dedup import near_dedup
from loreweave.shared import shared_folder

#: A document whose best language scores less is rejected.
LEAST_SCORE = 0.3
#: Of each thread, the tables in the shared folder that its last stage has written for itself.
_held: dict[int, list[str]] = {}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """A stage reads what its predecessor has written, so the predecessor's own tables can go when it begins, unless
    its input still reads them. A thread runs one pipeline at a time.

    Spark removes shuffle files once the plans that made them are collected, which a driver with memory to spare puts
    off; collecting here frees the predecessor's before this stage writes its own.
    """

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _drop_held(spark, docs)
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        with owned_tables() as written:
            out = f(spark, docs, sf_dir)
        _held.setdefault(get_ident(), []).extend(written)
        return out

    return run


def _drop_held(spark: SparkSession, docs: DataFrame) -> None:
    needed, held = tables_read(docs), _held.pop(get_ident(), [])
    keep = [p for p in held if any(p.removeprefix("file:").strip("/") in x for x in needed)]
    remove(spark, [p for p in held if p not in keep])
    if keep:
        _held[get_ident()] = keep


def _numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a row number, written once, and that column's name, which no other column has.

    Operators answer by row, so that null or repeated ids can't let one row decide for another.
    """
    row = "row_number"
    while row in {c.lower() for c in docs.columns}:
        row += "_"
    return materialise(docs.withColumn(row, F.monotonically_increasing_id()), "pipeline-rows"), row


def _one_of_each(docs: DataFrame, rows: DataFrame, row: str, answers: DataFrame, group: str) -> DataFrame:
    """Of the rows of each group, by ``answers`` for row numbers, the one with the smallest doc_id, and of these the first."""
    ids = rows.select(F.col(row).alias("n"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("id"))
    first = answers.select(F.col("doc_id").alias("n"), F.col(group).alias("g")).join(ids, "n").groupBy("g").agg(F.min(F.struct("id", "n")).alias("first"))
    return rows.join(first.select(F.col("first.n").alias(row)), row, "left_semi").select(*(F.col(f"`{c}`") for c in docs.columns))


@_stage
def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that are in a learned language by a score of LEAST_SCORE or more.

    In practice only null texts and texts without letters go: a text in no learned language scores about 0.4 to 0.6, as
    do some short texts in learned ones. Rows are judged one by one, so repeated rows fare alike and ids may be null; long
    texts are read whole. Without a column lang, or with no labels, nothing is learned and all rows go. An empty table stays empty.
    """
    return language_id(docs, carry=True).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select("row.*")


@_stage
def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of texts that are equal but for white space, that with the smallest doc_id.

    A null id is behind all others; of rows that share the smallest id, one stays. Null and blank texts differ as "" and
    " " do, a null one being empty. Texts are compared whole. An empty table stays empty.
    """
    rows, row = _numbered(docs)
    return _one_of_each(docs, rows, row, exact_dedup(rows, id_col=row), "keep_id")


@_stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, that with the smallest doc_id: five words a shingle,
    similarity 0.8.

    A null id is behind all others; of rows that share the smallest id, one stays. Null, empty and blank texts have no
    shingles and all stay. Texts are compared whole. An empty table stays empty.
    """
    rows, row = _numbered(docs)
    return _one_of_each(docs, rows, row, near_dedup(rows, id_col=row), "component_id")


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that have a window of a benchmark item, whether the item has an id or not.

    Null and empty texts, and items without words, hit nothing; rows are judged one by one, whatever their ids, and
    texts are searched whole. An empty table stays empty, and an empty benchmark drops nothing.
    """
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), items_without_id=True, carry=True).filter("not contaminated").select("row.*")


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with their number and digests: a row for each row, also where ids repeat or are null.

    A null or empty text has no tokens; long texts are encoded whole. An empty table gives an empty result.
    """
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), ids=True)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("bpe_encode", encode),
]

#: SQL can't express the first stage; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another. What a stage reads and has written for itself goes once its result is written; the
    last result stays in the shared folder for the reader.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        _drop_held(spark, docs)
        if before:
            remove(spark, [before])
        before = path
    return docs
