"""Files of a knowledge base: JSONL and Parquet tables, and versioned snapshots behind a pointer."""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import reduce
from pathlib import Path
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreweave.errors import ConflictError, ValidationError
from loreweave.sources.files import Files


def read_bundle(files: Files, path: str | Path, *, delete: bool = False) -> list[dict[str, Any]]:
    """The items of a YAML bundle; with delete, the file goes afterwards, even if it can't be read."""
    text = files.read(path)
    try:
        items = yaml.safe_load(text)
        if not isinstance(items, list):
            raise ValidationError("A bundle must be a list of items")
        return items
    finally:
        if delete:
            files.remove(path)


def read_jsonl(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """All JSON lines under a folder by an explicit schema; columns that a file lacks are null."""
    if not Files(spark).any_file(folder, (".json", ".jsonl", ".json.gz", ".jsonl.gz")):
        return spark.createDataFrame([], schema)
    loose = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])
    return spark.read.schema(loose).option("recursiveFileLookup", True).json(folder)


def dump(df: DataFrame, folder: str, *, by_date: bool = True, rows_per_file: int = 1000) -> int:
    """Writes JSON lines, by the day of creation in folders YYYYMMDD (``unknown`` without one) or flat; returns rows.

    Days are spread over tasks by id too, so a day that holds most of the rows doesn't meet in one task.
    """
    n = df.count()
    if not n:
        return 0
    writer = df
    if by_date:
        day = F.coalesce(F.date_format("__created_at", "yyyyMMdd"), F.lit("unknown"))
        writer = df.withColumn("dt", day).repartitionByRange("dt", "__id").sortWithinPartitions("dt", "__id").write.partitionBy("dt")
    else:
        writer = df.repartitionByRange("__id").sortWithinPartitions("__id").write
    # Spark's own formats keep milliseconds only
    times = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    writer.mode("overwrite").option("maxRecordsPerFile", rows_per_file).option("ignoreNullFields", False).options(**times).json(folder)
    return n


def partition_counts(df: DataFrame, rows_per_file: int = 1000) -> DataFrame:
    """What a dump by date will write: dt, rows and least number of files."""
    day = F.coalesce(F.date_format("__created_at", "yyyyMMdd"), F.lit("unknown"))
    return df.groupBy(day.alias("dt")).agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_files", F.ceil(F.col("n_rows") / F.lit(rows_per_file)))


#: A table in a manifest: the folder of its rows, or such a folder and the changes after it.
Held = str | dict[str, Any]


def folders(held: Held) -> list[str]:
    """The folders of a table, relative to the root: its base, and its changes in order."""
    return [held] if isinstance(held, str) else held["at"]


class Version:
    """A version in the making: tables are written as they come, and readers see none of them before commit."""

    def __init__(self, snapshots: Snapshots) -> None:
        self.snapshots, self.name = snapshots, f"v-{uuid.uuid4().hex}"
        self.path = f"{snapshots.root}/{self.name}"
        self.number, self.manifest, tops = snapshots.latest()
        self.tops = dict(tops)
        self.written: dict[str, Held] = {}
        self.parts = 0

    def _new(self, table: str) -> str:
        """A folder that this version hasn't used, relative to the root."""
        self.parts += 1
        return f"{self.name}/{table}~{self.parts}"

    def read(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        """A table as it stands in this version."""
        held = (self.manifest | self.written).get(table)
        return spark.createDataFrame([], schema) if held is None else self.snapshots.frame(spark, held, schema)

    def write(self, table: str, df: DataFrame) -> DataFrame:
        """Writes a whole table and reads it again, so that what is derived from it doesn't compute it anew."""
        at = self._new(table)
        df.write.parquet(f"{self.snapshots.root}/{at}")
        self.written[table] = at
        return df.sparkSession.read.schema(df.schema).parquet(f"{self.snapshots.root}/{at}")

    def change(self, table: str, rows: DataFrame, key: str | None = None, keys: DataFrame | None = None, layout: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
        """Rows take the place of all that have their key or one of ``keys``, a table with the column ``key``; without a key they are added.

        Returns the rows. They and the keys are written beside the table, so a change writes about what it changes. The
        table is written anew where it is small (``delta_from`` bytes), or where its changes have become many (``most_deltas``)
        or large (``most_share`` of its base); readers merge them until then. ``layout`` orders rows for their readers.
        """
        spark, root, limits = rows.sparkSession, self.snapshots.root, self.snapshots
        held = (self.manifest | self.written).get(table)
        if held is None:
            return self.write(table, layout(rows))
        base, *changes = folders(held)
        size = {x: limits.files.size(f"{root}/{x}") for x in (base, *changes)}
        if sum(size.values()) < limits.delta_from:
            kept = limits.frame(spark, held, rows.schema)
            if key:
                kept = kept.join(keys.select(key).unionByName(rows.select(key)), key, "left_anti").select(*rows.columns)
            self.write(table, layout(kept.unionByName(rows)))
            return rows
        at = self._new(table)
        layout(rows).write.parquet(f"{root}/{at}/rows")
        written = spark.read.schema(rows.schema).parquet(f"{root}/{at}/rows")
        if key:
            keys.select(key).unionByName(written.select(key)).distinct().write.parquet(f"{root}/{at}/gone")
        entry = {"key": key, "at": [base, *changes, at]}
        late = sum(size.values()) - size[base] + limits.files.size(f"{root}/{at}")
        if len(changes) >= limits.most_deltas or late > limits.most_share * size[base]:
            self.write(table, layout(limits.frame(spark, entry, rows.schema)))
        else:
            self.written[table] = entry
        return written

    def top(self, table: str, known: Callable[[], int]) -> int:
        """The highest id that a table has ever given out; ``known`` tells it for tables from before this was kept."""
        if table not in self.tops:
            self.tops[table] = known()
        return self.tops[table]

    def raise_top(self, table: str, to: int | None) -> None:
        self.tops[table] = max(self.tops.get(table, 0), to or 0)

    def commit(self) -> None:
        """Tables that were not written stay where the version before has them. The pointer after that version's is
        created, which fails if another writer was faster.
        """
        files = self.snapshots.files
        files.mkdirs(self.path)
        files.write(f"{self.path}/MANIFEST.json", json.dumps({"tables": self.manifest | self.written, "tops": self.tops}, indent=1, sort_keys=True))
        if not files.create(self.snapshots.pointer(self.number + 1), self.name):
            raise ConflictError("Another writer has published a version since this one began")

    def abort(self) -> None:
        self.snapshots.files.remove(self.path)


class Snapshots:
    """Versions of all tables under a root; numbered pointers name them, and readers use the last.

    A version holds what changed with it, and a manifest of where all tables are and of the highest ids given out. A pointer
    is created in one step and only if its number is free, so readers see all of a version or nothing, and no writer
    overwrites another's; no table is copied. The root may be on any file system that Hadoop knows.

    delta_from, most_deltas, most_share: when a change rewrites its table (see Version.change).
    """

    def __init__(self, root: str | Path, spark: SparkSession, *, delta_from: int = 4 << 20, most_deltas: int = 8, most_share: float = 0.25) -> None:
        self.root, self.files = str(root).rstrip("/"), Files(spark)
        self.delta_from, self.most_deltas, self.most_share = delta_from, most_deltas, most_share
        self.files.mkdirs(self.root)
        self._pin = threading.local()

    def pointer(self, number: int) -> str:
        return f"{self.root}/CURRENT-{number:012d}"

    def _pointers(self) -> list[int]:
        return [int(n.removeprefix("CURRENT-")) for n in self.files.names(self.root) if n.startswith("CURRENT-")]

    def latest(self) -> tuple[int, dict[str, Held], dict[str, int]]:
        """The number of the current version, 0 if there is none, where its tables are, and the highest ids given out.

        Within pinned(), what was current when that began.
        """
        if (held := getattr(self._pin, "held", None)) is not None:
            return held
        number = max(self._pointers(), default=0)
        return (number, *self._manifest(number))

    def _manifest(self, number: int) -> tuple[dict[str, Held], dict[str, int]]:
        if not number:
            return {}, {}
        told = json.loads(self.files.read(f"{self.root}/{self.files.read(self.pointer(number)).strip()}/MANIFEST.json"))
        return (told["tables"], told["tops"]) if "tables" in told else (told, {})

    @contextmanager
    def pinned(self) -> Iterator[None]:
        """All that this thread reads meanwhile comes from one version."""
        if getattr(self._pin, "held", None) is not None:
            yield
            return
        self._pin.held = self.latest()
        try:
            yield
        finally:
            self._pin.held = None

    @property
    def current(self) -> str | None:
        """The name of the current version."""
        number = self.latest()[0]
        return self.files.read(self.pointer(number)).strip() if number else None

    def manifest(self) -> dict[str, Held]:
        return self.latest()[1]

    def frame(self, spark: SparkSession, held: Held, schema: T.StructType) -> DataFrame:
        """The rows of a table: of those with one key, what its last change says.

        Changed keys are few against the rows of a large table, so the join usually broadcasts them, and filters on other
        columns reach the scans.
        """
        base, *changes = [f"{self.root}/{at}" for at in folders(held)]
        read = spark.read.schema(schema).parquet
        if not changes:
            return read(base)
        parts = [read(base), *[read(f"{at}/rows") for at in changes]]
        if held["key"] is None:
            return reduce(DataFrame.unionByName, parts)
        key = T.StructType([schema[held["key"]]])
        gone = [spark.read.schema(key).parquet(f"{at}/gone").withColumn("__change", F.lit(i)) for i, at in enumerate(changes, 1)]
        last = reduce(DataFrame.unionByName, gone).groupBy(held["key"]).agg(F.max("__change").alias("__last"))
        rows = reduce(DataFrame.unionByName, [part.withColumn("__change", F.lit(i)) for i, part in enumerate(parts)])
        return rows.join(last, held["key"], "left").filter(F.coalesce("__last", F.lit(0)) == F.col("__change")).select(*schema.names)

    def read(self, spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
        """A table; with the ending ``.*``, all slices of it as one."""
        at = self.manifest()
        names = [n for n in at if n.startswith(table[:-1])] if table.endswith(".*") else [table] * (table in at)
        plain = [f"{self.root}/{at[n]}" for n in sorted(names) if isinstance(at[n], str)]
        parts = [spark.read.schema(schema).parquet(*plain)] if plain else []
        parts += [self.frame(spark, at[n], schema) for n in sorted(names) if not isinstance(at[n], str)]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)

    @contextmanager
    def version(self) -> Iterator[Version]:
        """A version that is committed at the end, or removed on any error."""
        v = Version(self)
        try:
            yield v
            if v.written:
                v.commit()
            else:
                v.abort()
        except BaseException:
            v.abort()
            raise

    def publish(self, tables: dict[str, DataFrame]) -> None:
        with self.version() as v:
            for name, df in tables.items():
                v.write(name, df)

    def prune(self, keep: int = 2, least_age: float = 3600.0) -> None:
        """Removes folders that none of the last ``keep`` versions names, and older pointers.

        What was changed within ``least_age`` seconds stays, as a version in the making or a reader may need it.
        """
        numbers = sorted(self._pointers())
        named, now = set(), time.time()
        for n in numbers[-keep:]:
            named |= {at for held in self._manifest(n)[0].values() for at in folders(held)} | {self.files.read(self.pointer(n)).strip()}
        for version in (n for n in self.files.names(self.root) if n.startswith("v-")):
            if self.files.age(f"{self.root}/{version}", now) < least_age:
                continue
            for table in self.files.names(f"{self.root}/{version}"):
                if f"{version}/{table}" not in named and table != "MANIFEST.json":
                    self.files.remove(f"{self.root}/{version}/{table}")
            if version not in named and set(self.files.names(f"{self.root}/{version}")) <= {"MANIFEST.json"}:
                self.files.remove(f"{self.root}/{version}")
        for n in numbers[:-keep]:
            self.files.remove(self.pointer(n))
