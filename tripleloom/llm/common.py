"""Shared helpers of the training-data operators: scratch tables, word hashing, bounded batches, groups of neighbouring ids.

Words are the runs of bytes outside ``[\\x20\\x09-\\x0D]`` of the UTF-8 text, with A-Z lower-cased. They are hashed
straight from the column's buffer, many at once: a word's hash is a polynomial over 64-bit values of its bytes, scrambled
together with its length.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by a Python worker; a longer single text is one batch of its own.
BATCH_BYTES = 1 << 20
#: Bytes that Spark sends a worker at once; a longer single row is a batch of its own.
ARROW_BYTES, SENT_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
#: Longer words are hashed one by one.
LONG_WORD = 1 << 14
GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    with np.errstate(over="ignore"):
        values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


# ---- scratch tables ----


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that ``spark.checkpoint.dir`` names. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that all of them share")
        base = "file://" + tempfile.mkdtemp(prefix="checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame, path: str, compression: str = "zstd") -> None:
    """Write ``df``; the shuffle files of this one execution go when it ends."""
    spark = df.sparkSession
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors. With ``scratch_buckets`` (a column
    and a number) it is a table in these buckets, so that a join by that column does not move it."""
    spark, path, buckets = df.sparkSession, scratch(df.sparkSession, name), getattr(df, "scratch_buckets", None)
    if buckets is None:
        written(df, path)
        out = spark.read.schema(df.schema).parquet(path)
    else:
        table, before = f"scratch_{uuid.uuid4().hex}", spark.conf.get(WRITERS)
        spark.conf.set(WRITERS, "2")  # a task's rows need no sort by bucket
        try:
            df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(buckets[1], buckets[0]).saveAsTable(table)
        finally:
            spark.conf.set(WRITERS, before)
        out = spark.table(table)
        out.scratch_table = table
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that no later step reads."""
    for table in tables:
        spark = table.sparkSession
        if name := getattr(table, "scratch_table", None):
            spark.sql(f"DROP TABLE {name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def bucket_of(column: str, n: int) -> Column:
    """crc32 of the id's decimal text, modulo n; -1 for a null id."""
    return F.coalesce(F.expr(f"crc32(cast(cast({column} as string) as binary)) % {n}"), F.lit(-1))


def bucket_numbers(values: np.ndarray, n: int) -> np.ndarray:
    """The buckets of n that Spark puts 64-bit values in: Murmur3 with the seed 42."""
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    h = np.full(len(values), 42, dtype=np.uint32)
    for half in (values.view(np.uint64) & np.uint64(0xFFFFFFFF), values.view(np.uint64) >> np.uint64(32)):
        k = rot(half.astype(np.uint32) * np.uint32(0xCC9E2D51), 15) * np.uint32(0x1B873593)
        h = rot(h ^ k, 13) * np.uint32(5) + np.uint32(0xE6546B64)
    h ^= np.uint32(8)
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64) % n


# ---- batches ----


def by_bytes(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES, per_row: int = 64) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of ``column``, where each row counts ``per_row`` bytes more."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        part = np.cumsum(lengths + per_row) // limit
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield batch.slice(a, b - a)


def trim() -> None:
    """Hand freed memory back to the system, so that a waiting worker stays small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df`` through ``run``. Rows reach it in batches bounded in bytes, whatever their length (unless the session has a bound of its own),
    and a worker hands its memory back at the end of each task."""
    conf = df.sparkSession.conf
    if conf.get(ARROW_BYTES, None) is None:
        conf.set(ARROW_BYTES, SENT_BYTES)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(whole, schema)


# ---- words ----

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
with np.errstate(over="ignore"):
    _LETTER = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
_LETTER[65:91] = _LETTER[97:123]
_LETTER[_SPACE] = 0
_BASE = np.uint64(0xD6E8FEB86659FD93)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        with np.errstate(over="ignore"):
            _POWERS = np.concatenate([np.ones(1, np.uint64), np.full(max(n, 2 * len(_POWERS)) - 1, _BASE)]).cumprod(dtype=np.uint64)
    return _POWERS


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; a null text is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def word_edges(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each text."""
    if not len(data):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_SPACE[data]
    joint = np.zeros(len(data) + 1, dtype=bool)  # between the bytes: whether a word goes on
    joint[1:-1] = inside[1:] & inside[:-1]
    joint[offsets] = False
    starts = np.flatnonzero(inside & ~joint[:-1])
    ends = np.flatnonzero(inside & ~joint[1:]) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(column: pa.Array, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, one after the other, and the number of words of each text."""
    data, offsets = text_bytes(column)
    starts, ends, counts = word_edges(data, offsets)
    out = np.empty(len(starts), dtype=np.uint64)
    cuts = np.searchsorted(starts, np.arange(0, len(data) + block, block)) if len(starts) else []
    with np.errstate(over="ignore"):
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            last = j - 1 if ends[j - 1] - starts[j - 1] > LONG_WORD else j  # a very long word may reach far beyond the block
            if last > i:
                low, at = int(starts[i]), starts[i:last] - starts[i]
                values = _LETTER[data[low : int(ends[last - 1])]]
                place = np.arange(len(values)) - np.repeat(at, np.diff(np.append(at, len(values))))
                values *= _powers(int(place.max()) + 1)[place]
                out[i:last] = np.add.reduceat(values, at)
        lengths = ends - starts
        for k in np.flatnonzero(lengths > LONG_WORD):
            out[k] = xxhash.xxh3_64_intdigest(_LOWER[data[starts[k] : ends[k]]].tobytes())
        return mix(out + lengths.astype(np.uint64) * GOLD), counts


# ---- groups of neighbouring ids ----


def id_groups(docs: DataFrame, rows: int = 2048, most: int = 20_000) -> tuple[np.ndarray, int]:
    """Bounds that cut the rows of docs, in doc_id order, into groups of about ``rows`` rows, and the number of groups that
    null ids take. They come from a sample of at most about 32 x ``most`` ids, so at most ``most`` groups, however the
    ids are spaced; an id with many rows gets several equal bounds."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"))
    seen = ids.agg(F.count("doc_id").alias("n"), F.count_if(F.col("doc_id").isNull()).alias("nulls")).first()
    groups = min(most, max(1, seen["n"] // rows))
    part = max(1, seen["n"] // (32 * groups))
    picked = ids.filter("doc_id is not null").filter(F.pmod(F.xxhash64("doc_id", "row"), F.lit(part)) == 0)
    sample = np.sort(picked.select("doc_id").toArrow().column("doc_id").to_numpy())
    at = np.arange(1, groups) * len(sample) // groups
    return sample[at] if len(sample) else np.empty(0, np.int64), min(most, -(-seen["nulls"] // rows))


def group_numbers(ids: pa.Array, bounds: np.ndarray, nulls: int, row: int) -> np.ndarray:
    """The group of each id; ``row`` is the number of the first of them in its task. Rows of an id with several bounds, and of null ids, are dealt out."""
    values = ids.fill_null(0).to_numpy(zero_copy_only=False)
    low, high = (np.searchsorted(bounds, values, side=s) for s in ("left", "right"))
    turn = row + np.arange(len(values))
    out = low + turn % np.maximum(1, high - low)
    return np.where(ids.is_valid().to_numpy(zero_copy_only=False), out, len(bounds) + 1 + turn % max(1, nulls))
