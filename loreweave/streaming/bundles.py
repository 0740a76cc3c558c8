"""Upserts from streams: an extension; nothing else here needs streaming."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loreweave.errors import ConflictError
from loreweave.operators.merge import last_wins, upsert
from loreweave.sources.store import Snapshots

#: How often a batch is tried anew if other writers publish meanwhile.
TRIES = 5


def upsert_stream(stream: DataFrame, read: Callable[[], DataFrame], publish: Callable[[DataFrame], None], keys: Sequence[str], *, order: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch into the table that read gives, by keys, the last in ``order`` winning."""

    def merge(batch: DataFrame, _: int) -> None:
        publish(upsert(read(), last_wins(batch, keys, [order]), keys, now=F.current_timestamp().cast("timestamp_ntz")))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_stream(stream: DataFrame, store: Snapshots, table: str, key: str, *, order: str, checkpoint: str) -> StreamingQuery:
    """Keeps in a table of the store, for each key, the row that is last in ``order``, of all that a stream has brought.

    A batch is published with its number in one version, so one that comes again after a failure, before or after the
    publishing, counts once; numbers are kept for each query, which its checkpoint identifies. Rows come late as they like:
    one that is before the row of its key, in any batch, changes nothing. Of rows equal in ``order``, the greatest by their other
    columns counts, so however batches are cut, the table is the same. Rows with a null key are passed over, and a null order
    is before all. A batch writes what it changes; columns must be of types with an order.
    """
    spark, schema = stream.sparkSession, stream.schema
    rank = F.struct(order, *[c for c in schema.names if c not in (key, order)])

    def publish(batch: DataFrame, number: int) -> None:
        mark = f"stream.{batch.sparkSession.sparkContext.getLocalProperty('sql.streaming.queryId')}"
        for tried in range(1, TRIES + 1):
            try:
                take(batch, number, mark)
                return
            except ConflictError:
                if tried == TRIES:
                    raise

    def take(batch: DataFrame, number: int, mark: str) -> None:
        with store.version() as version:
            if version.top(mark, lambda: 0) > number:
                return  # nothing is written, so no version comes of it
            new = last_wins(batch.filter(F.col(key).isNotNull()), [key], [rank])
            held = version.read(spark, table, schema).select(F.col(key).alias("__key"), rank.alias("__held"))
            later = new.join(held, F.col(key) == F.col("__key"), "left").filter(F.col("__key").isNull() | (rank > F.col("__held"))).select(*schema.names)
            version.change(table, later, key, later.select(key).limit(0))
            version.raise_top(mark, number + 1)

    return stream.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: Sequence[str], time: str, within: str) -> DataFrame:
    """Drops repeats of a key that come within some time of it."""
    return stream.withWatermark(time, within).dropDuplicatesWithinWatermark(list(keys))
