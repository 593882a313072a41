"""A persisted vector index: lists around centroids, of which a search reads the nearest few.

Centroids are fitted by spherical k-means on a bounded sample (at most ``SAMPLE`` vectors, by key hash); every vector is then stored in
the list of its nearest centroid, as parquet partitioned by list, so that a search prunes all other lists at the scan. With as many
``probes`` as lists the search is exact. A list of very many rows is met in blocks.

Defined results: rows without a vector, or with a zero vector, are not in the index; an empty index finds nothing; ties go to the
key that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import cosine, literal
from ..sources.scratch import stored
from .nearest import met, vectors_of

SAMPLE = 20_000
MOST_LISTS = 4096


@dataclass(frozen=True)
class VectorIndex:
    spark: SparkSession
    path: str
    centroids: np.ndarray

    def rows(self) -> DataFrame:
        return self.spark.read.schema("key string, embedding array<double>, list int").parquet(f"{self.path}/rows")


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 1) -> np.ndarray:
    """Unit centroids by spherical k-means; an empty one starts anew at a vector of the sample."""
    rng = np.random.default_rng(seed)
    x = unit(sample)
    c = x[rng.permutation(len(x))[: min(lists, len(x))]]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        empty = np.flatnonzero(np.bincount(own, minlength=len(c)) == 0)
        sums[empty] = x[rng.integers(0, len(x), len(empty))]
        c = unit(sums)
    return c


def listed(rows: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """key, embedding, list: each row with its ``probes`` nearest lists. rows is (key, embedding)."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)  # at most MOST_LISTS vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = shared.value
        for batch in batches:
            for part in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                x = vectors_of(part.column("embedding"))
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                at = np.repeat(np.arange(part.num_rows), near.shape[1])
                yield pa.RecordBatch.from_arrays([part.column("key").take(pa.array(at)), part.column("embedding").take(pa.array(at)), pa.array(near.ravel().astype(np.int32))], names=["key", "embedding", "list"])

    return rows.mapInArrow(run, "key string, embedding array<double>, list int")


def usable(rows: DataFrame, key: str) -> DataFrame:
    """key, embedding of rows that have a vector of some length."""
    own = rows.select(F.col(key).cast("string").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    return own.filter(F.exists("embedding", lambda x: x != 0))


def build(rows: DataFrame, key: str, path: str, lists: int | None = None) -> VectorIndex:
    """Index every row of rows (key, embedding) at ``path``. About sqrt(rows) lists, at most MOST_LISTS."""
    spark, own = rows.sparkSession, usable(rows, key)
    n = own.count()
    lists = min(MOST_LISTS, lists or max(1, int(np.sqrt(n))))
    share = max(1, n // SAMPLE)
    sample = own.filter(F.pmod(F.xxhash64("key"), F.lit(share)) == 0).orderBy("key").limit(2 * SAMPLE).select("embedding").toArrow()
    found = centroids_of(vectors_of(sample.column("embedding")), lists) if sample.num_rows else np.zeros((0, 0))
    spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(found)], "list int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
    if len(found):
        # a list's rows are dealt to a few tasks, so that one huge list is not one task's work
        dealt = listed(own, found, 1).repartition("list", F.pmod(F.xxhash64("key"), F.lit(8)))
        dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/rows")
    else:
        spark.createDataFrame([], "key string, embedding array<double>, list int").write.mode("overwrite").parquet(f"{path}/rows")
    return VectorIndex(spark, path, found)


def load(spark: SparkSession, path: str) -> VectorIndex:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect())  # at most MOST_LISTS rows
    return VectorIndex(spark, path, np.array([r["centroid"] for r in rows]))


def top_k(index: VectorIndex, vector: list[float], k: int, probes: int = 8, mode: str = "normalized") -> DataFrame:
    """key, score of the k nearest in the ``probes`` lists nearest to the vector; only those lists are read."""
    if not len(index.centroids):
        return index.rows().select("key", F.lit(0.0).alias("score")).limit(0)
    near = np.argsort(-(index.centroids @ np.array(vector)), kind="stable")[:probes].tolist()
    scored = index.rows().filter(F.col("list").isin(near)).select("key", cosine(F.col("embedding"), literal(vector), mode).alias("score"))
    return scored.orderBy(F.desc("score"), "key").limit(k)


def probes_for(index: VectorIndex, k: int, recall: float = 0.95, queries: int = 64) -> int:
    """The least power of two of probes with which ``queries`` rows of the index (by key hash) find this share of their k nearest, by
    comparison with a search of all lists. How many it takes depends on the data: few for clustered vectors, most lists for evenly spread ones."""
    lists = len(index.centroids)
    asked = stored(index.rows().orderBy(F.xxhash64("key"), "key").limit(queries).select(F.col("key").alias("qkey"), "embedding"), "asked")
    exact = stored(nearest(asked, index, k, lists, "raw").select("qkey", "ckey"), "exact")
    total, probes = exact.count(), 1
    while probes < lists and nearest(asked, index, k, probes, "raw").join(exact, ["qkey", "ckey"], "left_semi").count() < recall * total:
        probes *= 2
    return max(1, min(probes, lists))


def nearest(queries: DataFrame, index: VectorIndex, k: int, probes: int = 8, mode: str = "normalized", block: int = 4096) -> DataFrame:
    """qkey, ckey, score, rank of the k nearest of the index to each of queries (qkey, embedding), within its ``probes`` lists."""
    rows = index.rows()
    q = listed(usable(queries, "qkey"), index.centroids, probes) if len(index.centroids) else index.spark.createDataFrame([], rows.schema)
    sizes = F.broadcast(rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks")))  # at most MOST_LISTS rows
    c = rows.join(sizes, "list").select("key", "embedding", "list", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int").alias("block"))
    asked = q.join(sizes, "list").select("key", "embedding", "list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    # queries of one list are dealt to groups too
    turns = F.broadcast(q.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("turns")))
    asked = asked.join(turns, "list").withColumn("turn", F.pmod(F.xxhash64("key", F.lit(1)), F.col("turns")).cast("int")).drop("turns")
    c = c.join(turns, "list").select("key", "embedding", "list", "block", F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"))
    return met(asked, c, ["list", "block", "turn"], k, mode)
