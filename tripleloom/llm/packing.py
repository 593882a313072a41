"""Order-preserving packing of documents into fixed-size token sequences.

Documents are dealt to groups of neighbouring ids (``common.id_groups``: by rank in a bounded sample of ids, so the spacing of
ids does not matter, and an id with very many rows gets several groups). A group is sorted by id and read as a stream that is cut
into segments of about ``segment_tokens`` tokens at document ends. In each segment dynamic programming chooses where windows of
at most ``size`` tokens are cut:

    cost(cuts) = sum of padding + cut penalties
    padding(window) = 0 at a power of two, else size - length
    penalty(cut) = 0 at a document's end, ``sentence_cost`` at a sentence's end, ``hard_cost`` elsewhere

For a cut at position p the best earlier cut q, within p - size, minimises cost(q) + q, so a monotone queue
holds the sliding minimum and each cut costs amortised constant time; windows of a power of two are tried beside it.

Defined results: a null or empty text is the end id alone; rows with an equal doc_id are each packed as a document of
their own; rows with a null doc_id come last, dealt to groups of their own; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, group_numbers, id_groups, in_batches
from .tokenids import CACHE_CHUNKS, Encoder, sentence_ends

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bits of a sequence_id that number the sequences of one group.
LOCAL_BITS = 40
#: Tokens of a segment, about.
SEGMENT_TOKENS = 1 << 17


def cut_windows(positions: list[int], penalties: list[float], size: int) -> list[int]:
    """The chosen positions, from the first (0) to the last. Neighbouring positions are at most ``size`` apart."""
    n = len(positions)
    index = {p: i for i, p in enumerate(positions)}
    powers = [1 << k for k in range(6, size.bit_length()) if 1 << k < size]
    cost, keyed, before = [0.0] * n, [0.0] * n, [0] * n
    queue = deque([0])
    for j in range(1, n):
        p = positions[j]
        while positions[queue[0]] < p - size:
            queue.popleft()
        at = queue[0]
        best = keyed[at] + size - p
        for s in powers:
            i = index.get(p - s)
            if i is not None and cost[i] < best:
                best, at = cost[i], i
        cost[j] = best = best + penalties[j]
        before[j] = at
        keyed[j] = best = best + p
        while queue and keyed[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    cuts, j = [positions[-1]], n - 1
    while j:
        j = before[j]
        cuts.append(positions[j])
    return cuts[::-1]


def candidates(doc_ends: np.ndarray, sentence_cuts: np.ndarray, size: int, sentence_cost: float, hard_cost: float) -> tuple[list[int], list[float]]:
    """Where the stream may be cut and what that costs."""
    total = int(doc_ends[-1])
    tail = np.arange(64, min(total, size), 64)
    soft = np.unique(np.concatenate([[0], sentence_cuts, doc_ends]))
    gaps = np.flatnonzero(np.diff(soft) > size)
    fill = [np.arange(soft[g] + size, soft[g + 1], size) for g in gaps]
    places = np.unique(np.concatenate([soft, total - tail, *fill]))
    cost = np.full(len(places), hard_cost)
    cost[np.searchsorted(places, soft)] = sentence_cost
    cost[np.searchsorted(places, doc_ends)] = 0.0
    return places.tolist(), cost.tolist()


def pack_stream(ids: list[np.ndarray], ends: np.ndarray, size: int, sentence_cost: float, hard_cost: float) -> dict[str, np.ndarray]:
    """Pieces of one stream of documents, in order; ``document`` and ``sequence`` are positions from 0."""
    stream = np.concatenate(ids)
    doc_ends = np.cumsum([len(x) for x in ids])
    marks = np.flatnonzero(ends[np.minimum(stream, len(ends) - 1)]) + 1
    cuts = np.array(cut_windows(*candidates(doc_ends, marks, size, sentence_cost, hard_cost), size))
    starts = np.concatenate([[0], doc_ends[:-1]])
    edges = np.union1d(cuts, starts)
    begin, length = edges[:-1], np.diff(edges)
    document = np.searchsorted(starts, begin, side="right") - 1
    sequence = np.searchsorted(cuts, begin, side="right") - 1
    raw = stream.astype("<u4").tobytes()
    crc = [zlib.crc32(raw[4 * b : 4 * (b + n)]) for b, n in zip(begin.tolist(), length.tolist(), strict=True)]
    return {"document": document, "start": begin - starts[document], "length": length, "crc": np.array(crc, dtype=np.int64), "sequence": sequence, "offset": begin - cuts[sequence]}


def id_width(encoder: Encoder) -> str:
    """How an id is stored: in 16 bits where the vocabulary allows."""
    return "<u2" if len(encoder.id_bytes) <= 1 << 16 else "<u4"


def tokenised(docs: DataFrame, path: str, end_id: int, bounds: np.ndarray, nulls: int) -> DataFrame:
    """part (the group), doc_id, crc, ids (packed integers) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(bounds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, row = encoder_of(path, end_id), TaskContext.get().partitionId() * 7919
        width = id_width(encoder)
        for batch in by_bytes(batches):
            raw = [encoder.encode(x) for x in batch.column("text").to_pylist()]
            ids = [np.frombuffer(x, dtype="<u4").astype(width).tobytes() for x in raw]
            part = group_numbers(batch.column("doc_id"), shared.value, nulls, row)
            row += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int64)), batch.column("doc_id"), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(ids, pa.binary())], names=["part", "doc_id", "crc", "ids"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).transform(in_batches, run, "part long, doc_id long, crc long, ids binary")


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, size: int = 2048, segment_tokens: int = SEGMENT_TOKENS, sentence_cost: float = 12.0, hard_cost: float = 60.0, rows_per_group: int = 2048) -> DataFrame:
    """One row for each piece of a document in a sequence. See the module's text for rules and edge cases."""
    bounds, nulls = id_groups(docs, rows_per_group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = sentence_ends_of(tokenizer_path)
        width = "<u2" if len(ends) <= 1 << 16 else "<u4"
        part, sequences, held, names, tokens = None, 0, [], [], 0

        def done() -> pa.RecordBatch:
            got = pack_stream(held, ends, size, sentence_cost, hard_cost)
            lengths = np.array([len(x) for x in held])
            columns = {
                "doc_id": pa.array(names, pa.int64()).take(pa.array(got["document"])),
                "start": pa.array(got["start"], pa.int64()),
                "length": pa.array(got["length"], pa.int64()),
                "ids_crc32": pa.array(got["crc"], pa.int64()),
                "doc_tokens": pa.array(lengths[got["document"]], pa.int64()),
                "sequence_id": pa.array(got["sequence"] + sequences + (part << LOCAL_BITS), pa.int64()),
                "offset": pa.array(got["offset"], pa.int64()),
            }
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        for batch in batches:
            for group, name, body in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                if held and (group != part or tokens >= segment_tokens):
                    out = done()
                    yield out
                    sequences = int(pa.compute.max(out.column("sequence_id")).as_py()) - (part << LOCAL_BITS) + 1
                    held, names, tokens = [], [], 0
                if group != part:
                    part, sequences = group, 0
                held.append(np.frombuffer(body.as_buffer(), dtype=width))
                names.append(name)
                tokens += len(held[-1])
        if held:
            yield done()

    dealt = tokenised(docs, tokenizer_path, end_id, bounds, nulls).repartition("part")
    return dealt.sortWithinPartitions("part", F.col("doc_id").asc_nulls_last(), "crc").drop("crc").transform(in_batches, run, SCHEMA)


_ENDS: dict[str, np.ndarray] = {}
_ENCODERS: dict[tuple[str, int, int], Encoder] = {}


def sentence_ends_of(path: str) -> np.ndarray:
    """Read once by each worker."""
    if path not in _ENDS:
        _ENDS[path] = sentence_ends(path)
    return _ENDS[path]


def encoder_of(path: str, end_id: int, remember: int = CACHE_CHUNKS) -> Encoder:
    """Read once by each worker, which keeps what the encoder remembers (at most ``remember`` words) from task to task."""
    if (path, end_id, remember) not in _ENCODERS:
        _ENCODERS[path, end_id, remember] = Encoder(path, end_id, remember)
    return _ENCODERS[path, end_id, remember]
