"""Content-addressed store of token ids.

Writing: a gear hash rolls over each document's ids and cuts them where its low bits are all zero (at least
``low`` and at most ``high`` ids), so an insertion moves only the cuts near it. A chunk's address is the
blake2b-128 of its bytes; every distinct chunk is stored once, in a table bucketed by address. A recipe lists a
document's addresses, its id count and the Merkle root over its addresses; recipes are written in ascending doc_id order, in
runs (groups of neighbouring ids, ``common.id_groups``). The manifest holds for each run its number of documents
and ids, the ids of all runs before it, and the Merkle root over its documents' roots. The few chunks that very many documents
use are listed too (at most ``HOT`` of them, each at most ``high`` ids).

Reading: runs are folded again from the recipes and compared with the manifest, so that a lost, repeated, changed or
reordered recipe is noticed; recipes are joined to the bucketed chunks (only addresses are shuffled to meet them; the listed
chunks are broadcast, so no address is a hot key), the pieces come together by document, and length and Merkle root
are verified before anything is returned; a mismatch raises an error. Nothing is collected to the driver.

Defined results: a null or empty text is the end id alone; rows with an equal doc_id are separate documents, told
apart by ``start``; a null doc_id sorts last; an empty table gives empty tables; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_bytes, discard, group_numbers, id_groups, in_batches, scratch, stored, written
from .packing import encoder_of, id_width

STAGED = "run long, doc_id long, n_tokens long, crc long, recipe array<binary>, root binary, new_ids array<binary>, new_chunks array<binary>"
RECIPES = "run long, doc_id long, n_tokens long, within long, recipe array<binary>, root binary"
#: Addresses a worker remembers, so that it passes on a repeated chunk once.
REMEMBERED = 200_000
#: Words a worker remembers with their ids, about 150 bytes each.
REMEMBERED_WORDS = 1_500_000
#: A chunk is listed where its uses are over one in so many of all uses; so at most so many chunks are.
HOT = 1024


def gear_table(seed: int = 7, size: int = 1 << 16) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 32, size, dtype=np.uint32)


def rolling(ids: np.ndarray, gear: np.ndarray) -> np.ndarray:
    """h[i] = sum over k < 32 of gear[ids[i - k]] << k, by doubling."""
    h = gear[ids & np.uint32(len(gear) - 1)]
    for s in (1, 2, 4, 8, 16):
        if len(h) > s:
            h[s:] = h[s:] + (h[:-s] << np.uint32(s))
    return h


def marks_of(ids: np.ndarray, gear: np.ndarray, bits: int) -> np.ndarray:
    """Where the hash of the last 32 ids asks for a cut. A text's first cut is at 32 ids or more, so many texts can be hashed as one."""
    return np.flatnonzero(rolling(ids, gear) >> np.uint32(32 - bits) == 0) + 1


def cuts_of(n: int, marks: list[int], low: int, high: int) -> list[int]:
    """Chunk ends of n ids, the last of them n."""
    out, at = [], 0
    for m in [*marks, n]:
        while m - at > high:
            at += high
            out.append(at)
        if m - at >= low and m < n:
            at = m
            out.append(at)
    if at < n:
        out.append(n)
    return out


def blake(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def merkle(addresses: list[bytes]) -> bytes:
    """The root of a binary tree; an odd last node goes up as it is. Leaves and nodes are told apart by a prefix."""
    level = [blake(b"\0" + a) for a in addresses]
    while len(level) > 1:
        pairs = [blake(b"\1" + level[i] + level[i + 1]) for i in range(0, len(level) - 1, 2)]
        level = pairs + level[len(level) // 2 * 2 :]
    return level[0] if level else blake(b"")


class Fold:
    """The Merkle root over a stream of leaves, in memory that grows with the logarithm of their number."""

    def __init__(self):
        self.whole: list[tuple[int, bytes]] = []  # roots of full trees, the largest first

    def add(self, leaf: bytes) -> None:
        height, node = 0, blake(b"\0" + leaf)
        while self.whole and self.whole[-1][0] == height:
            node, height = blake(b"\1" + self.whole.pop()[1] + node), height + 1
        self.whole.append((height, node))

    def root(self) -> bytes:
        nodes = [n for _, n in self.whole]
        while len(nodes) > 1:
            right = nodes.pop()
            nodes[-1] = blake(b"\1" + nodes[-1] + right)
        return nodes[0] if nodes else blake(b"")


@dataclass(frozen=True)
class Store:
    chunks: str  # table, bucketed by chunk_id
    recipes: str  # path
    manifest: str  # path
    hot: str  # path of the chunks that very many documents use
    width: str  # of an id in a chunk


def stage(docs: DataFrame, tokenizer_path: str, end_id: int, low: int, bits: int, high: int, bounds: np.ndarray, nulls: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(bounds)
    if low < 32:
        raise ValueError("low is under the 32 ids that the rolling hash looks back")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, gear, known, row = encoder_of(tokenizer_path, end_id, REMEMBERED_WORDS), gear_table(), set(), TaskContext.get().partitionId() * 7919
        width = id_width(encoder)
        step = int(width[2])
        for batch in by_bytes(batches):
            out: dict[str, list] = {k: [] for k in ("n", "crc", "recipe", "root", "ids", "chunks")}
            texts = [encoder.encode(t) for t in batch.column("text").to_pylist()]
            ids = np.frombuffer(b"".join(texts), dtype="<u4")
            ends = np.cumsum([len(x) // 4 for x in texts])
            marks, raw = marks_of(ids, gear, bits), ids.astype(width).tobytes()
            edges = np.searchsorted(marks, ends)
            base, before = 0, 0
            for text, end, edge in zip(texts, ends.tolist(), edges.tolist(), strict=True):
                at, recipe, new, bodies = base, [], [], []
                for cut in cuts_of(end - base, (marks[before:edge] - base).tolist(), low, high):
                    body = raw[at * step : (base + cut) * step]
                    recipe.append(address := blake(body))
                    if address not in known:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        known.add(address)
                        new.append(address)
                        bodies.append(body)
                    at = base + cut
                for k, v in zip(out, (end - base, zlib.crc32(text), recipe, merkle(recipe), new, bodies), strict=True):
                    out[k].append(v)
                base, before = end, edge
            part = group_numbers(batch.column("doc_id"), shared.value, nulls, row)
            row += batch.num_rows
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.binary()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()))
            columns = [pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), batch.column("doc_id"), *columns], names=[c.split()[0] for c in STAGED.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_batches, run, STAGED)


def running(staged: DataFrame) -> DataFrame:
    """Recipes in order, each with the ids of its run before it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, carried = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            runs, n = batch.column("run").to_numpy(), batch.column("n_tokens").to_numpy()
            new = np.concatenate([[runs[0] != last], runs[1:] != runs[:-1]])
            sums = np.cumsum(n) - n
            first = np.maximum.accumulate(np.where(new, np.arange(len(n)), -1))
            within = np.where(first < 0, sums + carried, sums - sums[np.maximum(first, 0)])
            last, carried = runs[-1], int(within[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("run", "doc_id", "n_tokens")), pa.array(within), batch.column("recipe"), batch.column("root")], names=[c.split()[0] for c in RECIPES.split(", ")])

    parts = int(staged.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged.select("run", "doc_id", "n_tokens", "recipe", "root", "crc").repartitionByRange(parts, "run")
    return dealt.sortWithinPartitions("run", F.col("doc_id").asc_nulls_last(), "crc").drop("crc").transform(in_batches, run, RECIPES)


def folded(recipes: DataFrame) -> DataFrame:
    """For each run of recipes: documents, tokens, and the Merkle root over its documents in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, documents, tokens, fold = None, 0, 0, Fold()
        row = lambda: pa.RecordBatch.from_arrays([pa.array([last], pa.int64()), pa.array([documents], pa.int64()), pa.array([tokens], pa.int64()), pa.array([fold.root()], pa.binary())], names=["run", "documents", "tokens", "digest"])
        for batch in batches:
            for r, n, root, doc, at in zip(*(batch.column(c).to_pylist() for c in ("run", "n_tokens", "root", "doc_id", "within")), strict=True):
                if r != last:
                    if last is not None:
                        yield row()
                    last, documents, tokens, fold = r, 0, 0, Fold()
                fold.add(root + repr((doc, at, n)).encode())
                documents, tokens = documents + 1, tokens + n
        if last is not None:
            yield row()

    light = recipes.select("run", "within", "doc_id", "n_tokens", "root").repartition("run")
    return light.sortWithinPartitions("run", "within", "root").mapInArrow(run, "run long, documents long, tokens long, digest binary")


def write(docs: DataFrame, tokenizer_path: str, end_id: int = 1, low: int = 64, bits: int = 8, high: int = 1024, rows_per_run: int = 2048) -> Store:
    """Encode, chunk and store all documents."""
    spark = docs.sparkSession
    staged = stored(stage(docs, tokenizer_path, end_id, low, bits, high, *id_groups(docs, rows_per_run)), "id-stage")
    table = f"id_chunks_{uuid.uuid4().hex}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = staged.select(F.explode(F.arrays_zip(F.col("new_ids").alias("chunk_id"), F.col("new_chunks").alias("body"))).alias("c"))
    unique = pairs.select("c.chunk_id", "c.body").repartition(parts, "chunk_id").dropDuplicates(["chunk_id"])
    unique.write.option("compression", "zstd").bucketBy(parts, "chunk_id").format("parquet").saveAsTable(table)
    recipes, manifest, hot = (scratch(spark, f"id-{x}") for x in ("recipes", "manifest", "hot"))
    written(running(staged), recipes)
    kept = spark.read.schema(RECIPES).parquet(recipes)
    runs = folded(kept)  # a row for each run, of which there is a bounded number
    before = F.sum("tokens").over(Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1))
    written(runs.withColumn("before", F.coalesce(before, F.lit(0))), manifest)
    uses = stored(kept.select(F.explode("recipe").alias("chunk_id")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("uses")), "id-uses")
    total = uses.agg(F.coalesce(F.sum("uses"), F.lit(0)).alias("n")).first()["n"]
    often = uses.filter(F.col("uses") > F.lit(total / HOT)).select("chunk_id")
    written(spark.table(table).join(F.broadcast(often), "chunk_id").select("chunk_id", "body"), hot)
    discard(staged, uses)
    return Store(table, recipes, manifest, hot, id_width(encoder_of(tokenizer_path, end_id)))


def verify(recipes: DataFrame, manifest: DataFrame) -> None:
    """Raises where a run of recipes differs from the manifest."""
    now, then = (df.select("run", F.struct("documents", "tokens", "digest").alias(name)) for df, name in ((folded(recipes), "now"), (manifest, "then")))
    if not now.join(then, "run", "full_outer").filter(~F.col("now").eqNullSafe(F.col("then"))).isEmpty():
        raise ValueError("the stored recipes differ from their manifest")


def read(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens, ids (32-bit, little-endian) of every document, verified against the manifest and its Merkle root."""
    recipes = spark.read.schema(RECIPES).parquet(store.recipes)
    manifest = spark.read.schema("run long, documents long, tokens long, digest binary, before long").parquet(store.manifest)
    hot = F.broadcast(spark.read.schema("chunk_id binary, body binary").parquet(store.hot))  # at most HOT chunks
    verify(recipes, manifest)
    placed = recipes.join(F.broadcast(manifest.select("run", "before")), "run").withColumn("start", F.col("before") + F.col("within"))
    asked = placed.select("doc_id", "start", "n_tokens", "root", F.posexplode("recipe").alias("place", "chunk_id"))
    rest = asked.join(hot.select("chunk_id"), "chunk_id", "left_anti").join(spark.table(store.chunks), "chunk_id", "left")
    found = rest.unionByName(asked.join(hot, "chunk_id")).drop("chunk_id")
    whole = found.groupBy("doc_id", "start", "n_tokens", "root").agg(F.sort_array(F.collect_list(F.struct("place", "body"))).alias("parts"))
    width = store.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            parts = batch.column("parts")
            ends = parts.offsets.to_pylist()
            pieces = parts.values.field("body").to_pylist()
            for n, root, a, b in zip(batch.column("n_tokens").to_pylist(), batch.column("root").to_pylist(), ends, ends[1:], strict=False):
                bodies = pieces[a:b]
                if None in bodies or merkle([blake(x) for x in bodies]) != root:
                    raise ValueError("a stored document differs from its recipe")
                ids = np.frombuffer(b"".join(bodies), dtype=width).astype("<u4")
                if len(ids) != n:
                    raise ValueError("a stored document differs from its recipe in length")
                out.append(ids.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), pa.array(out, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return whole.transform(in_batches, run, "doc_id long, start long, n_tokens long, ids binary")


def digest_of(read_back: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32."""
    return read_back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
