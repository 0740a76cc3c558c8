"""Joins that Spark has no operator for."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loreweave.shared import cut


def asof_join(left: DataFrame, right: DataFrame, on: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """left with ``values`` of the last row of right that has equal keys and is not later, null if there is none.

    Both sides have the keys ``on`` and the time ``at``; of right's rows of one time, the greatest by values counts. A row of
    left with a null key or time gets nulls.

    Both sides are dealt together in ranges of key and time, so a key that most rows have spreads over many tasks. Each
    range finds the last row within itself; what it takes over from ranges before it comes from a table of one row for
    each range and key.
    """
    keys = [F.col(k) for k in on]
    value = F.struct(F.col(at).alias("at"), *[F.col(v) for v in values])
    rows = left.select(*keys, F.col(at).alias("__at"), F.lit(None).cast(right.select(value.alias("v")).schema[0].dataType).alias("__v"), F.struct(*[F.col(c) for c in left.columns]).alias("__row"))
    known = reduce(Column.__and__, [k.isNotNull() for k in (*keys, F.col(at))])
    seen = right.filter(known).select(*keys, F.col(at).alias("__at"), value.alias("__v"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"))
    both = cut(rows.unionByName(seen).repartitionByRange(*on, "__at", F.col("__row").isNotNull()).withColumn("__part", F.spark_partition_id()))
    # right's rows come before left's of the same time
    before = Window.partitionBy("__part", *on).orderBy("__at", F.col("__row").isNotNull(), "__v").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("__own", F.last("__v", ignorenulls=True).over(before)).filter("__row is not null")
    last = both.groupBy("__part", *on).agg(F.max("__v").alias("__last"))
    earlier = Window.partitionBy(*on).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    taken = last.select("__part", *on, F.last("__last", ignorenulls=True).over(earlier).alias("__taken")).filter("__taken is not null")
    same = [F.col("l.__part") == F.col("r.__part"), *[F.col(f"l.{k}") == F.col(f"r.{k}") for k in on]]
    found = F.when(F.col("__row").getField(at).isNotNull(), F.coalesce("__own", "__taken"))
    joined = own.alias("l").join(taken.alias("r"), same, "left").select("__row", found.alias("__v"))
    return joined.select("__row.*", *[F.col("__v").getField(v).alias(v) for v in values])


def interval_join(left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Pairs of rows with equal keys ``on`` whose spans, of whole numbers and with both ends, overlap.

    Returns left's columns and those of right that aren't in ``on``, which must have other names. Null keys, null ends and
    spans that end before they begin join nothing.

    A span's class is the least c so that 2**c is over its length; in bins of that width or more it has two at most. The longer
    span of a pair, of equal ones right's, stands in the bins of its own class, and the other looks there. So spans of
    all lengths meet by equality, a row goes to two bins for each class that is there and not below its own (63 at most), and
    no long span is spread over many small bins. A pair that shares two bins counts in that where the later of
    both begins. A bin that most rows are in is a skewed key of an inner join, which Spark splits.
    """
    mine, other = F.struct(*left.columns).alias("__l"), F.struct(*[c for c in right.columns if c not in on]).alias("__r")
    keys = [f"__k{i}" for i in range(len(on))]

    def spans(rows: DataFrame, row: Column, ends: tuple[str, str]) -> DataFrame:
        a, b = (F.col(e).cast("long") for e in ends)
        known = reduce(Column.__and__, [F.col(k).isNotNull() for k in on], a <= b)
        size = F.length(F.bin(b - a))
        return rows.filter(known).select(*[F.col(k).alias(x) for k, x in zip(on, keys, strict=True)], a.alias("__a"), b.alias("__b"), F.when(b == a, 0).otherwise(size).cast("int").alias("__c"), row)

    l_rows, r_rows = spans(left, mine, left_span), spans(right, other, right_span)
    bin_of = lambda x, c: F.call_function("shiftright", x, c)
    bins = lambda a, b, c: F.sequence(bin_of(a, c), bin_of(b, c))

    def met(long: DataFrame, short: DataFrame, classes: list[int], equal: bool) -> DataFrame:
        """Pairs of which ``long`` has the higher class, or an equal one."""
        there = F.array(*[F.lit(c) for c in classes])
        stand = long.select(*keys, "__c", F.explode(bins(F.col("__a"), F.col("__b"), F.col("__c"))).alias("__bin"), *[c for c in long.columns if c in ("__l", "__r")], F.col("__a").alias("__long_a"), F.col("__b").alias("__long_b"))
        look = short.withColumn("__to", F.explode(F.filter(there, lambda c: (c >= F.col("__c")) if equal else (c > F.col("__c")))))
        look = look.select(*keys, F.col("__to").alias("__c"), F.explode(bins(F.col("__a"), F.col("__b"), F.col("__to"))).alias("__bin"), *[c for c in short.columns if c in ("__l", "__r")], "__a", "__b")
        pairs = stand.join(look, [*keys, "__c", "__bin"]).filter((F.col("__a") <= F.col("__long_b")) & (F.col("__long_a") <= F.col("__b")))
        return pairs.filter(F.col("__bin") == bin_of(F.greatest("__a", "__long_a"), F.col("__c"))).select("__l", "__r")

    def classes(rows: DataFrame) -> list[int]:
        return sorted(r[0] for r in rows.select("__c").distinct().collect())  # 64 at most

    both = met(r_rows, l_rows, classes(r_rows), True).unionByName(met(l_rows, r_rows, classes(l_rows), False))
    return both.select("__l.*", "__r.*")
