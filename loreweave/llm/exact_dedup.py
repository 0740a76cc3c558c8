"""Exact deduplication by an extendible-hash index on shared files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.llm.common import NULL_ID, materialise, owned_path

SCHEMA = "doc_id long, keep_id long, group_size long, kept boolean, text_sha256 string"
#: Bits of the hash that the directory uses at most; the driver holds one number for each of their values.
MOST_BITS = 20
#: Buckets of the intended size at most; beyond, buckets grow with the input, so that the bits always suffice to split.
MOST_BUCKETS = 1 << (MOST_BITS - 4)
#: Representatives that one task keeps in memory for merging copies before anything is shuffled.
LOCAL_BYTES = 24 << 20
#: Rows that are Python objects at once.
SLICE = 1000


class Directory:
    """An extendible-hash directory: 2**depth slots by leading hash bits, several of which may share a bucket.

    Built from the bytes under each value of the leading ``bits`` bits. A bucket over capacity splits by its next
    bit; if it was as deep as the directory, the directory doubles. Only a bucket of one value of all bits can stay
    overfull; an owner reads it in order and holds the texts of one hash.
    """

    def __init__(self, bytes_under: dict[int, int], bits: int, capacity: int) -> None:
        self.depth = 0
        self.slots: list[tuple[int, int]] = [(0, 0)]  # of each slot, its bucket: local depth and leading bits
        todo = [(0, 0, sorted(bytes_under.items()))]
        while todo:
            depth, lead, held = todo.pop()
            if sum(n for _, n in held) <= capacity or depth == bits:
                continue
            if depth == self.depth:
                self.slots = [s for s in self.slots for _ in range(2)]
                self.depth += 1
            width = 1 << (self.depth - depth - 1)
            at = (lead << 1) * width
            self.slots[at : at + 2 * width] = [(depth + 1, lead << 1)] * width + [(depth + 1, lead << 1 | 1)] * width
            bit = bits - depth - 1
            for b in (0, 1):
                todo.append((depth + 1, lead << 1 | b, [x for x in held if x[0] >> bit & 1 == b]))

    def buckets(self) -> list[tuple[int, int]]:
        """First slot and number of slots of each bucket, in order."""
        out = []
        for i, s in enumerate(self.slots):
            if i == 0 or s != self.slots[i - 1]:
                out.append([i, 0])
            out[-1][1] += 1
        return [tuple(x) for x in out]


ENTRIES = "doc_id long, rep_id long, hash long, sha string, n long, norm string"
_KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()]
_NAMES = ["doc_id", "rep_id", "hash", "sha", "n", "norm"]


def _merge_local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Copies within a task point to one of them; only that row goes on with its text and their number and least id.

    Rows have their place (row_id), doc_id, hash, normalised text and its digest. What is remembered is bounded: when it
    is full, it is given out and forgotten, and later copies get another representative.
    """
    held: dict[int, list[list]] = {}  # by hash: texts, representative rows, counts, least ids and digests
    size = 0

    def given() -> pa.RecordBatch:
        rows = [(r[3], r[1], h, r[4], r[2], r[0]) for h, chain in held.items() for r in chain]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(_KINDS)], names=_NAMES)

    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        reps = []
        for row, key, h, norm, sha in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            order = NULL_ID if key is None else key
            chain = held.setdefault(h, [])
            for r in chain:  # a chain has all texts of one hash; bytes decide
                if r[0] == norm:
                    r[2] += 1
                    r[3] = min(r[3], order)
                    break
            else:
                r = [norm, row, 1, order, sha]
                chain.append(r)
                size += len(norm) + 300
            reps.append(r[1])
        none = pa.nulls(len(reps))
        yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(reps, pa.int64()), batch.column(2), batch.column(4), none.cast(pa.int64()), none.cast(pa.string())], names=_NAMES)
        if size > LOCAL_BYTES:
            yield given()
            held, size = {}, 0
    if held:
        yield given()


INDEX = "bucket int, hash long, sha string, rep_id long, keep_id long, group_size long"


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """An owner's key range, in order of hash: chains the distinct texts of each hash and compares bytes.

    Gives the entries of its bucket: for each representative, the least id and the number of all its copies.
    """
    at, chain = None, []
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def given() -> pa.RecordBatch:
        out = [(*at, sha, rep, keep, n) for _, keep, n, reps, sha in chain for rep in reps]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["bucket", "hash", "sha", "rep_id", "keep_id", "group_size"])

    for batch in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
        for bucket, h, sha, rep, least, n, norm in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (bucket, h) != at:
                if chain:
                    yield given()
                at, chain = (bucket, h), []
            for c in chain:
                if c[0] == norm:
                    c[1], c[2] = min(c[1], least), c[2] + n
                    c[3].append(rep)
                    break
            else:
                chain.append([norm, least, n, [rep], sha])
    if chain:
        yield given()


def _normalised(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    norm = F.regexp_replace(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), norm.alias("norm"))
    return rows.select("row_id", "doc_id", F.xxhash64("norm").alias("hash"), "norm", F.sha2("norm", 256).alias("sha"))


def _lead(bits: int) -> F.Column:
    return F.shiftright("hash", 64 - bits) + F.lit(1 << (bits - 1))


def build_index(entries: DataFrame, path: str, bucket_mb: int) -> DataFrame:
    """Writes the index of the representatives in ``entries`` and returns its entries.

    path/directory has a row for each slot: its number and bucket, of ``bits`` leading bits of the hash. path/buckets
    has a folder of files for each bucket, in order of hash.
    """
    spark = entries.sparkSession
    reps = entries.filter("norm is not null")
    size = reps.agg(F.sum(F.octet_length("norm") + F.lit(64))).first()[0] or 0
    capacity = max(bucket_mb << 20, -(-size // MOST_BUCKETS))
    bits = min(MOST_BITS, max(6, (size // capacity).bit_length() + 4))
    under = reps.groupBy(_lead(bits).alias("lead")).agg(F.sum(F.octet_length("norm") + F.lit(64)).alias("n"))
    directory = Directory({r[0]: r[1] for r in under.collect()}, bits, capacity)
    buckets = directory.buckets()
    slots = spark.createDataFrame([(i + j, b, directory.depth) for b, (i, n) in enumerate(buckets) for j in range(n)], "slot long, bucket int, depth int")
    slots.coalesce(1).write.parquet(f"{path}/directory")
    slots = spark.read.schema(slots.schema).parquet(f"{path}/directory")
    # 2**MOST_BITS slots at most
    reps = reps.withColumn("slot", F.shiftright(_lead(bits), bits - directory.depth)).join(F.broadcast(slots.select("slot", "bucket")), "slot")
    owned = reps.repartitionById(len(buckets), F.col("bucket")).sortWithinPartitions("bucket", "hash", "rep_id")
    index = owned.select("bucket", "hash", "sha", "rep_id", F.col("doc_id").alias("least"), "n", "norm").mapInArrow(_own, INDEX)
    index.write.option("compression", "zstd").partitionBy("bucket").parquet(f"{path}/buckets")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(INDEX).parquet(f"{path}/buckets")


def lookup(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Looks up texts in an index on shared files: doc_id, and keep_id and group_size of the equal texts there, or null.

    A text finds its slot by the leading bits of its hash, and the bucket's entries by hash and digest; Spark reads the
    files of the buckets that it needs.
    """
    spark = docs.sparkSession
    slots = spark.read.parquet(f"{path}/directory")
    rows = _normalised(docs, id_col, text_col).select("doc_id", "hash", "sha")
    depth = slots.first()["depth"]
    rows = rows.withColumn("slot", _lead(depth) if depth else F.lit(0).cast("long")).join(F.broadcast(slots.drop("depth")), "slot")
    held = read_index(spark, path).select("bucket", "hash", "sha", "keep_id", "group_size").distinct()
    keep = F.when(F.col("keep_id") != NULL_ID, F.col("keep_id"))
    return rows.join(held, ["bucket", "hash", "sha"], "left").select("doc_id", keep.alias("keep_id"), "group_size")


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_mb: int = 16, index_path: str | None = None) -> DataFrame:
    """Groups rows whose texts are identical after replacing each run of white space by one space.

    1. Tasks merge their own copies and write entries: for every row, its representative; for every representative,
       hash, text, number of copies and least id. So copies of one text shuffle once per task, however many there are.
    2. The directory comes from the bytes under each leading hash value; bits and capacity follow the input.
    3. Owner tasks take one bucket each, a key range of the hash, in hash order; they chain collisions, compare bytes and
       write the bucket's files next to the directory, in ``index_path`` or in the shared folder.
    4. Every row looks up its representative in these files.

    Of equal texts the row with the smallest doc_id stays. A null text counts as empty; a null id is behind all others,
    and keep_id is null if no copy has an id. Rows that repeat both text and the smallest id all stay. A text of any
    length is compared whole. An empty table gives an empty result; other columns are ignored, whatever their names.
    """
    entries = materialise(_normalised(docs, id_col, text_col).mapInArrow(_merge_local, ENTRIES), "dedup-entries")
    index = build_index(entries, index_path or owned_path(docs.sparkSession, "dedup-index"), bucket_mb).select("rep_id", "keep_id", "group_size")
    members = entries.filter("norm is null").select("doc_id", "rep_id", "sha")
    keep = F.when(F.col("keep_id") != NULL_ID, F.col("keep_id"))
    return members.join(index, "rep_id").select("doc_id", keep.alias("keep_id"), "group_size", F.coalesce(F.col("doc_id"), F.lit(NULL_ID)).eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))
