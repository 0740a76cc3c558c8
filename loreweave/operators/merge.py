"""Key-wise changes of tables, each as a plan that yields the next snapshot."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.shared import cut

_KEY = "__batch_key"


def last_wins(batch: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row of each key, the last in the given order."""
    latest = Window.partitionBy(*keys).orderBy(*[F.desc(c) if isinstance(c, str) else c.desc() for c in order])
    return batch.withColumn("__rn", F.row_number().over(latest)).filter("__rn = 1").drop("__rn")


def upsert(current: DataFrame, batch: DataFrame, keys: Sequence[str], *, now: Column, supplied: str | None = None, next_id: Column | None = None) -> DataFrame:
    """current with the rows of batch, unique by keys, inserted or merged in.

    Only supplied columns change: those of batch, or of each row, those named in its array column ``supplied``.
    Existing rows keep __id and __created_at. New rows get the ids that follow the highest, in order of key.
    """
    values = [c for c in current.columns if c not in (*keys, "__id", "__created_at", "__updated_at")]
    given = [c for c in values if c in batch.columns]
    b = batch.select(*[F.col(k).alias(f"b_{k}") for k in keys], *[F.col(c).alias(f"b_{c}") for c in given], *([F.col(supplied).alias("b__supplied")] if supplied else []), F.lit(True).alias(_KEY))
    on = [F.col(k).eqNullSafe(F.col(f"b_{k}")) for k in keys]
    joined = current.withColumn("__here", F.lit(True)).join(b, on, "full_outer")
    has = lambda c: F.array_contains("b__supplied", c) if supplied else F.lit(True)
    new = F.col("__here").isNull()
    changed = F.coalesce(F.col(_KEY), F.lit(False))
    merged = joined.select(
        F.col("__id"), F.when(new, now).otherwise(F.col("__created_at")).alias("__created_at"), F.when(changed, now).otherwise(F.col("__updated_at")).alias("__updated_at"),
        *[F.coalesce(F.col(k), F.col(f"b_{k}")).alias(k) for k in keys],
        *[(F.when(changed & has(c), F.col(f"b_{c}")).otherwise(F.col(c)) if c in given else F.col(c)).alias(c) for c in values],
    )
    top = next_id if next_id is not None else highest(current)
    return assign_ids(merged, keys, top).select(*current.columns)


def matching(current: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of current whose keys are in keys_df."""
    k = keys_df.select(*[F.col(x).alias(f"b_{x}") for x in keys])
    return current.join(k, [F.col(x).eqNullSafe(F.col(f"b_{x}")) for x in keys], "left_semi")


def changes(current: DataFrame, batch: DataFrame, keys: Sequence[str], *, now: Column, top: Column, supplied: str | None = None) -> DataFrame:
    """The rows that an upsert of batch makes or changes, and no others; new ones get the ids after ``top``.

    The batch meets the table in a semi join, which reads the table's keys and moves none of its rows if the batch is small.
    """
    return upsert(cut(matching(current, batch, keys)), batch, keys, now=now, supplied=supplied, next_id=top)


def loaded(current: DataFrame, rows: DataFrame, keys: Sequence[str], now: Column, top: Column | None = None) -> DataFrame:
    """current with rows read from files, which have all its columns; new ones get the ids after ``top`` (the highest, if None).

    Of rows with equal keys, the one last updated counts; those without a time come first, then lower ids. An empty table
    takes their ids and times, any other keeps its own.
    """
    batch = last_wins(rows, keys, [F.coalesce("__updated_at", "__created_at"), F.col("__id")])
    if current.isEmpty():
        known = batch.withColumn("__created_at", F.coalesce("__created_at", now)).withColumn("__updated_at", F.coalesce("__updated_at", now))
        own = highest(known)
        return assign_ids(known.select(*rows.columns), keys, own if top is None else F.greatest(top, own))
    return upsert(current, batch.drop("__id", "__created_at", "__updated_at"), keys, now=now, next_id=top)


def highest_id(rows: DataFrame, column: str = "__id") -> int:
    """The highest id, 0 if there is none."""
    return rows.agg(F.coalesce(F.max(column), F.lit(0).cast("long"))).first()[0]


def highest(rows: DataFrame, column: str = "__id") -> Column:
    return F.lit(highest_id(rows, column))


def assign_ids(rows: DataFrame, order: Sequence[str], top: Column | None = None) -> DataFrame:
    """Fills null __id from the highest on, in the given order.

    New rows are dealt by range and numbered within their part, from where the parts before end; the driver sees one
    number for each part.
    """
    top = top if top is not None else highest(rows)
    new = cut(rows.filter("__id is null").repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    before, total = [], 0
    for part, n in sorted(new.groupBy("__part").count().collect()):
        before.append((part, total))
        total += n
    offset = F.element_at(F.create_map(*[F.lit(x) for p in before for x in p]), F.col("__part")) if before else F.lit(0)
    numbered = new.withColumn("__id", top + offset + F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    return rows.filter("__id is not null").unionByName(numbered.drop("__part"))


def delete(current: DataFrame, keys_df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """current without the rows whose keys are in keys_df; keys that aren't there are ignored."""
    k = keys_df.select(*[F.col(x).alias(f"b_{x}") for x in keys]).distinct()
    return current.join(k, [F.col(x).eqNullSafe(F.col(f"b_{x}")) for x in keys], "left_anti")


def cascade(edges: DataFrame, gone: DataFrame, *, source: bool, target: bool) -> DataFrame:
    """edges without those that end in a node of gone (__id), at the ends whose type is the nodes' type."""
    ids = gone.select(F.col("__id").alias("__gone")).distinct()
    for end in ["__from_id"] * source + ["__to_id"] * target:
        edges = edges.join(ids, F.col(end) == F.col("__gone"), "left_anti")
    return edges


def ending_in(edges: DataFrame, gone: DataFrame, *, source: bool, target: bool) -> DataFrame:
    """__id of the edges that cascade() takes away."""
    ids = gone.select(F.col("__id").alias("__gone")).distinct()
    found = [edges.join(ids, F.col(end) == F.col("__gone"), "left_semi").select("__id") for end in ["__from_id"] * source + ["__to_id"] * target]
    return reduce(DataFrame.unionByName, found)


def resolve(batch: DataFrame, nodes: DataFrame, fields: dict[str, str], into: str) -> DataFrame:
    """batch with the ids of the nodes that it names; fields: batch column by identity column. Null if there is none."""
    n = nodes.select(F.col("__id").alias(into), *[F.col(k).cast("string").alias(f"n_{k}") for k in fields])
    return batch.join(n, [F.col(f"n_{k}") == F.col(c).cast("string") for k, c in fields.items()], "left").drop(*[f"n_{k}" for k in fields])


def violations(edges: DataFrame, nodes: DataFrame, end: str) -> DataFrame:
    """Edges whose end is no node."""
    return edges.join(nodes.select(F.col("__id").alias("__n")), F.col(end) == F.col("__n"), "left_anti")
