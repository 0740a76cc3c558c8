"""Samples by hash: bottom-k sketches, which are the same however rows are dealt and can be merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A stratum is cut in so many pieces first, so one that most rows are in is no task of its own.
PIECES = 64
#: Hashes are numbers below 2**52, which doubles hold exactly.
_BITS = 52


def priority(key: str, weight: str | None = None, salt: str = "") -> Column:
    """A row's place in the order of a sample: the hash of its key as a share of all hashes, above 0 and at most 1; with a
    weight w, the time -ln(share) / w, so heavy rows come early. Null where the key is null or the weight isn't above 0 and finite.
    """
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string"))), 1, _BITS // 4), 16, 10).cast("long")
    share = (head + 1).cast("double") / F.lit(float(1 << _BITS))
    if weight is None:
        return share
    w = F.col(weight).cast("double")
    return F.when((w > 0) & (w < F.lit(float("inf"))), -F.log(share) / w)


def bottom(rows: DataFrame, k: int, key: str, *, strata: Sequence[str] = (), weight: str | None = None, salt: str = "") -> DataFrame:
    """A sketch of rows: of each stratum the k + 1 of least priority, with the column ``priority``.

    Rows without priority are never picked. Rows of one key have one priority and are told apart by their other columns.
    A null is a stratum like any other. Rows of a stratum are cut in pieces, of which each keeps k + 1, so nothing but these
    meets.
    """
    if k < 0:
        raise ValueError("k must not be negative")
    known = rows.withColumn("priority", priority(key, weight, salt)).filter("priority is not null")
    return _cut(known.withColumn("__tie", F.xxhash64(*rows.columns)), k, strata)


def _cut(rows: DataFrame, k: int, strata: Sequence[str]) -> DataFrame:
    order = [F.col("priority"), F.col("__tie")]
    for groups in ([*strata, F.pmod(F.col("__tie"), F.lit(PIECES))], list(strata)):
        if not groups:
            rows = rows.orderBy(*order).limit(k + 1)
            continue
        rows = rows.withColumn("__rn", F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col("__rn") <= k + 1).drop("__rn")
    return rows.drop("__tie")


def merged(sketches: Sequence[DataFrame], k: int, *, strata: Sequence[str] = ()) -> DataFrame:
    """The sketch of all rows that the sketches, of k rows and the same salt, are of; no row may be in two of them."""
    both = sketches[0]
    for s in sketches[1:]:
        both = both.unionByName(s)
    return _cut(both.withColumn("__tie", F.xxhash64(*[c for c in both.columns if c != "priority"])), k, strata)


def sample(sketch: DataFrame, k: int, *, strata: Sequence[str] = (), weight: str | None = None) -> DataFrame:
    """k rows of each stratum of a sketch, or all if there are no more, and the ``chance`` that each had.

    The priority of the row after them is the bound; a row of weight w is below it with the chance 1 - exp(-w bound), without
    weights with the bound itself. Sums of value / chance over the rows of a condition estimate its sum without bias.
    """
    by = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))  # k + 1 rows of each stratum
    order = by.orderBy("priority", F.xxhash64(*[c for c in sketch.columns if c != "priority"]))
    bound = F.max(F.when(F.col("__rn") == k + 1, F.col("priority"))).over(by)
    chance = F.col("__bound") if weight is None else -F.expm1(-F.col(weight).cast("double") * F.col("__bound"))
    rows = sketch.withColumn("__rn", F.row_number().over(order)).withColumn("__bound", bound).filter(F.col("__rn") <= k)
    return rows.withColumn("chance", F.coalesce(chance, F.lit(1.0))).drop("__rn", "__bound")
