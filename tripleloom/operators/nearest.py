"""Vector search: top-k of one vector, and exact k nearest of many by blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vector import cosine, literal


def top_k(rows: DataFrame, key: str, vector: list[float], k: int, threshold: float | None = None, strict: bool = False, mode: str = "normalized", column: str = "embedding") -> DataFrame:
    """rows with ``score``: the k nearest first, then those over the threshold (>= or, if strict, >)."""
    scored = rows.withColumn("score", cosine(F.col(column), literal(vector), mode)).filter("score is not null")
    best = scored.orderBy(F.desc("score"), key).limit(k)
    if threshold is None:
        return best
    return best.filter(F.col("score") > threshold if strict else F.col("score") >= threshold)


def vectors_of(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of vectors of one length, straight from its buffer."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False)
    if len(array) and len(flat) % len(array):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(array), -1) if len(array) else np.zeros((0, 0))


def _units(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order, and their vectors at length 1; zero vectors go."""
    keys = np.array(table.column("key").to_pylist(), dtype=object)
    if not len(keys):
        return keys, np.zeros((0, 0))
    x = vectors_of(table.column("embedding"))
    length = np.linalg.norm(x, axis=1)
    x, keys = x[length > 0] / length[length > 0, None], keys[length > 0]
    order = np.argsort(keys)
    return keys[order], x[order]


def met(q: DataFrame, c: DataFrame, on: list[str], k: int, mode: str) -> DataFrame:
    """qkey, ckey, score, rank: the k best over all groups in which a query meets corpus rows. Both are (key, embedding, *on)."""

    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        (qk, qx), (ck, cx) = _units(left), _units(right)
        out = {"qkey": [], "ckey": [], "score": []}
        if len(qk) and len(ck):
            for i in range(0, len(qk), 512):
                s = qx[i : i + 512] @ cx.T
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                out["qkey"] += np.repeat(qk[i : i + 512], best.shape[1]).tolist()
                out["ckey"] += ck[best].ravel().tolist()
                out["score"] += np.take_along_axis(s, best, axis=1).ravel().tolist()
        return pa.table({"qkey": pa.array(out["qkey"], pa.string()), "ckey": pa.array(out["ckey"], pa.string()), "score": pa.array(out["score"], pa.float64())})

    found = q.groupBy(*on).cogroup(c.groupBy(*on)).applyInArrow(tile, "qkey string, ckey string, score double")
    if mode == "normalized":
        found = found.withColumn("score", (1 + F.col("score")) / 2)
    order = Window.partitionBy("qkey").orderBy(F.desc("score"), "ckey")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, corpus: DataFrame, k: int, mode: str = "normalized", block: int = 4096) -> DataFrame:
    """qkey, ckey, score, rank of the k nearest of corpus (ckey, embedding) to each of queries (qkey, embedding).

    Both sides are cut into blocks of about ``block`` rows; a task holds one block of each, multiplies them and
    keeps k of each query, and the k of all blocks meet by query: exact, without a cross join, in bounded memory. Its work is the
    product of both sides; ``vector_index`` searches a large corpus with less.
    Rows without a vector, or with a zero vector, have no neighbours.
    """
    n, m = (max(1, -(-df.filter("embedding is not null").count() // block)) for df in (queries, corpus))
    place = lambda df, key, parts: df.filter("embedding is not null").select(F.col(key).cast("string").alias("key"), F.col("embedding").cast("array<double>"), F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(parts)).cast("int").alias("own"))
    q = place(queries, "qkey", n).select("key", "embedding", F.col("own").alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("cb"))
    c = place(corpus, "ckey", m).select("key", "embedding", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("qb"), F.col("own").alias("cb"))
    return met(q, c, ["qb", "cb"], k, mode)


def similar_pairs(entities: DataFrame, k: int, threshold: float, cost: float, mode: str = "normalized") -> DataFrame:
    """src, dst, score, cost: pairs src < dst where dst is among the k nearest of src (src itself is one of them) and over the threshold."""
    near = nearest(entities.select(F.col("text").alias("qkey"), "embedding"), entities.select(F.col("text").alias("ckey"), "embedding"), k, mode)
    return near.filter((F.col("score") > threshold) & (F.col("qkey") < F.col("ckey"))).select(F.col("qkey").alias("src"), F.col("ckey").alias("dst"), "score", F.lit(cost).alias("cost"))
