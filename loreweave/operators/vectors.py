"""Exact vector search that leaves out what can't be among the best.

Unit vectors are dealt to clusters, each with a centre, and every row keeps its distance to it. A unit vector x of a cluster
with centre c is at least | |u - c| - |x - c| | from the query u, and the cosine of u and x is 1 - |u - x|^2 / 2. So once as many
rows are scored as are wanted, only distances within a ring around |u - c| can have a better one.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreweave.functions.vector import dot, literal
from loreweave.operators.search import top
from loreweave.shared import cut, values

#: Clusters at most, so that their centres can be held by the driver and in a broadcast.
MOST_CLUSTERS = 1024
#: Scores are rounded to six digits; distances are taken that much wider.
_SLACK = 1e-6


@dataclass(frozen=True)
class Clustered:
    """rows: the given columns, norm, cluster and distance, in order of the last two; heads: for each cluster its centre,
    number of rows, and least and greatest distance.
    """

    rows: DataFrame
    heads: DataFrame

    def write(self, path: str) -> None:
        self.rows.write.mode("overwrite").parquet(f"{path}/rows")
        self.heads.write.mode("overwrite").parquet(f"{path}/heads")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Clustered:
        return cls(spark.read.parquet(f"{path}/rows"), spark.read.parquet(f"{path}/heads"))


def clustered(rows: DataFrame, length: int, *, key: str = "id", vector: str = "vector", fit_rows: int = 50_000, seed: int = 1) -> Clustered:
    """Rows with a vector of ``length`` numbers, in clusters, about as many as the root of their number.

    Centres come from k-means over about ``fit_rows`` rows picked by a hash of their key; any centres give right results, and
    every row is dealt to the nearest. Null vectors, those of another length, of zeros only, or with numbers that are not
    finite have no place in a search by cosine and are left out.
    """
    fits = F.col(vector).isNotNull() & (F.size(vector) == length)
    known = rows.filter(fits).withColumn("norm", F.sqrt(dot(F.col(vector), F.col(vector)))).filter("norm > 0 and norm < double('inf')")  # NaN counts as greater
    n = known.count()
    unit = known.withColumn("__unit", F.transform(vector, lambda x: x.cast("double") / F.col("norm")))
    if not n:
        empty = known.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0.0))
        return Clustered(empty.limit(0), values(rows.sparkSession, [], _HEADS))
    ready = unit.withColumn("__features", array_to_vector("__unit"))
    share = min(1.0, fit_rows / n)
    sample = ready.filter(F.pmod(F.xxhash64(F.col(key)), F.lit(1 << 30)) < F.lit(math.ceil(share * (1 << 30)))).select("__features")
    k = min(MOST_CLUSTERS, max(2, math.isqrt(n - 1) + 1))
    # the solver by blocks fails where there are fewer distinct vectors than clusters
    fit = KMeans(k=k, seed=seed, maxIter=5, solver="row", featuresCol="__features", predictionCol="cluster")
    # a hash of few keys may pick none
    model = fit.fit(sample if share == 1.0 or not sample.isEmpty() else ready.limit(fit_rows).select("__features"))
    centres = values(rows.sparkSession, [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    away = F.sqrt(F.aggregate(F.zip_with("__unit", "centre", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    dealt = model.transform(ready).drop("__features").join(F.broadcast(centres), "cluster").withColumn("distance", away)  # MOST_CLUSTERS rows
    # by distance too, so a cluster that most rows are in is spread over files, of which a ring needs few
    held = cut(dealt.select(*rows.columns, "norm", "cluster", "distance").repartitionByRange("cluster", "distance").sortWithinPartitions("cluster", "distance"))
    heads = held.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min("distance").alias("near"), F.max("distance").alias("far")).join(F.broadcast(centres), "cluster")
    return Clustered(held, cut(heads.select("cluster", "centre", "n", "near", "far")))


_HEADS = "cluster int, centre array<double>, n long, near double, far double"


def scored(rows: DataFrame, query: Sequence[float], size: float, key: str, vector: str) -> DataFrame:
    """key and score of rows that have their norm; ``size`` is the query's."""
    return rows.select(key, F.round(dot(F.col(vector), literal(list(query))) / (F.col("norm") * F.lit(size)), 6).alias("score"))


def ring(heads: Sequence[tuple[int, float, float, float]], reach: float) -> list[tuple[int, float, float]]:
    """Of clusters (cluster, distance of the query from its centre, near, far), those that may have a row within ``reach`` of
    the query, and between which distances.
    """
    spans = [(c, max(near, d - reach), min(far, d + reach)) for c, d, near, far in heads]
    return [(c, low, high) for c, low, high in spans if low <= high]


def nearest(held: Clustered, query: Sequence[float], limit: int, *, key: str = "id", vector: str = "vector", keep: Column | None = None) -> DataFrame:
    """The ``limit`` best rows by cosine (key, score), as search.vector_scores and top() give them, of those that ``keep``.

    The clusters nearest to the query are scored first, in rounds of twice as many rows, until there are enough; then, of
    all others, the rows in the ring that the last of the best leaves open. A query of another length or of zeros finds nothing.
    """
    spark = held.rows.sparkSession
    query = list(array("f", [float(x) for x in query]))
    total = 0.0
    for x in query:  # in this order, as the columns add
        total += x * x
    size = math.sqrt(total)
    rows = held.rows if keep is None else held.rows.filter(keep)
    heads = held.heads.collect()  # MOST_CLUSTERS rows
    none = scored(rows.limit(0), query, size or 1.0, key, vector)
    if limit < 1 or not 0 < size < math.inf or not heads or len(query) != len(heads[0]["centre"]):
        return none
    away = {h["cluster"]: math.dist([x / size for x in query], h["centre"]) for h in heads}
    open_heads = sorted(heads, key=lambda h: (away[h["cluster"]], h["cluster"]))
    best: list = []
    want = limit
    while open_heads and len(best) < limit:
        now, n = [], 0
        while open_heads and n < want:
            h = open_heads.pop(0)
            now.append(h["cluster"])
            n += h["n"]
        want = 2 * n
        more = scored(rows.filter(F.col("cluster").isin(now)), query, size, key, vector)
        best = top(values(spark, best, none.schema).unionByName(more), limit, key).collect()
    known = values(spark, best, none.schema)
    if len(best) < limit or not open_heads:
        return top(known, limit, key)
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * (best[-1]["score"] - _SLACK))) + _SLACK
    spans = ring([(h["cluster"], away[h["cluster"]], h["near"], h["far"]) for h in open_heads], reach)
    if not spans:
        return top(known, limit, key)
    low, high = min(s[1] for s in spans), max(s[2] for s in spans)
    there = rows.filter(F.col("cluster").isin([s[0] for s in spans]) & F.col("distance").between(low, high))
    there = there.join(F.broadcast(values(spark, spans, "cluster int, __low double, __high double")), "cluster").filter("distance between __low and __high")
    return top(known.unionByName(scored(there, query, size, key, vector)), limit, key)
