"""Exact Jaccard join of documents on sets of word n-grams.

Two documents link when 100 * |x ∩ y| >= percent * |x ∪ y|. Steps, all of them distributed:

1. Sign: each text's set as 64-bit shingle hashes; its size and a 128-bit digest. Equal sets are one class from
   here on. The same pass counts shingles in a fixed table of 2^18 counters over all texts; a shingle whose counter
   stands far above the mean is "common".
2. Candidates without a miss: sizes fall in bands such that linked sets lie in the same or in neighbouring bands.
   Linked sets whose smaller one lies in band g differ in at most d(g) shingles, so when shingles are dealt to
   d(g) + 1 + e(g) parts by hash, at least 1 + e(g) parts are equal. A set with at most e(g) parts without an uncommon
   shingle leaves those parts out (an equal part with an uncommon shingle is left); any other set uses all parts. Keys are
   hashes of parts; the documents of one key are tied to one of them, so a key of m documents gives m - 1
   edges, and a map task first ties those it holds itself. Chance ties of unlike texts grow with the square of the rows and
   chain into large components; a component of more than one block (below) is parted again, by prefixes: with shingles in one order,
   seldom ones first, linked sets share one of the first |x| - ceil(percent * |x| / 100) + 1 of each. Documents that share
   such a shingle stay together, and one that shares none leaves. Any order is exact; the counts behind it are hashed into
   a table of at most ``ORDER_BYTES``, which a map task passes on in at most ``CHUNKS`` rows. Where that table is too small to tell
   seldom shingles, prefixes are longer by |x| // ``LONGER``, so that linked sets share 1 + min(|x|, |y|) // ``LONGER`` of them; each document
   may then leave the documents that it met under the fewest shingles, as long as linked ones are left with one (``firm_edges``).
3. Tiles: each component of that graph is one tile, or, when it has more than about ``tile_docs`` small sets (or fewer large
   ones: a set of n shingles counts n / 512), is cut into blocks of neighbouring sizes. First each block is a tile, with one pivot document in all blocks of a component; a group of near
   copies comes together there. What stays outside a component's largest joined part then meets the component's other
   documents in pairs of blocks whose sizes can link. Within a tile, hashed bitmaps bound the overlap from above,
   |x ∩ y| <= (|x| + |y| - popcount(X xor Y)) / 2; the pairs that pass are checked by intersecting the sorted arrays, the closest first, and a pair that is already connected is passed over. A tile
   returns a spanning forest of its links, so no set of all pairs is ever made.
4. Components of the links by minimum labels with pointer jumping.

Defined results: a null or blank text has an empty set and links with nothing; with fewer words than n the whole
sequence is the one shingle; rows with an equal doc_id are one node of the graph, each with its own set, its own place by size and its own row;
a row with a null doc_id links with nothing and has a null component_id; an empty table gives no rows; other columns
are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import GOLD, by_bytes, discard, in_batches, mix, stored, word_hashes

COUNTERS = 1 << 18
CHUNKS = 16
#: What a small set counts as, in shingles, when blocks are cut.
LEAST_COST = 512
#: Edges that one task turns into stars.
TASK_EDGES = 250_000
#: Counters (a byte each) that order the shingles of large components, at most; a power of two.
ORDER_BYTES = 1 << 26
#: The part of its shingles by which a set's prefix is longer where these counters are too few.
LONGER = 8


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and their numbers."""
    words, counts = word_hashes(texts)
    size = np.minimum(n, counts)
    totals = counts - size + (size > 0)
    starts = np.cumsum(totals) - totals
    first = np.cumsum(counts) - counts
    out = np.empty(int(totals.sum()), dtype=np.uint64)
    owner = np.repeat(np.arange(len(counts)), totals)
    with np.errstate(over="ignore"):
        for k in range(1, n + 1):  # texts of k words, or of n and more
            at = np.flatnonzero(size[owner] == k)
            word = first[owner[at]] + at - starts[owner[at]]
            h = np.full(len(at), np.uint64(k) * GOLD)
            for i in range(k):
                h = mix(h + words[word + i]) * GOLD
            out[at] = h
    for a, b in zip(starts.tolist(), (starts + totals).tolist(), strict=True):
        if b - a > 1:
            out[a:b].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = (out[1:] != out[:-1]) | (owner[1:] != owner[:-1])
    return out[new], np.bincount(owner[new], minlength=len(counts))


class Bands:
    """Size bands, the parts of each and how many of them may be left out; they go on as far as the largest set."""

    def __init__(self, percent: int, largest: int = 1 << 12):
        self.percent, self.edges = percent, np.ones(1, dtype=np.int64)
        self.reach(largest)

    def reach(self, largest: int) -> Bands:
        edges = self.edges.tolist()
        while edges[-1] <= largest:
            edges.append(100 * edges[-1] // self.percent + 1)
        self.edges = np.array(edges)
        differ = (100 - self.percent) * (self.edges[1:] - 1) // self.percent
        self.spare = np.where(differ > 0, 1 + differ // 8, 0)
        self.parts = differ + 1 + self.spare
        return self


def part_keys(flat: np.ndarray, sizes: np.ndarray, bands: Bands, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys and the position of the set each belongs to. ``common``: by shingle counter."""
    bands.reach(int(sizes.max(initial=0)))
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rare = ~common[(flat & np.uint64(COUNTERS - 1)).astype(np.int64)]
    band = np.searchsorted(bands.edges, sizes, side="right") - 1
    spots, values = mix(flat * GOLD + np.uint64(1)) >> np.uint64(16), mix(flat + GOLD)
    low, high = (values & np.uint64(0xFFFFFFFF)).astype(np.float64), (values >> np.uint64(32)).astype(np.float64)
    keys, owners = [], []
    for step in (0, 1):
        group = band - step
        ok = (group >= 0) & (sizes > 0)
        count = np.where(ok, bands.parts[np.maximum(group, 0)], 0)
        start = np.concatenate([[0], np.cumsum(count)])
        total = int(start[-1])
        if not total:
            continue
        used = ok[owner]
        at = start[owner[used]] + (spots[used] % count[owner[used]].astype(np.uint64)).astype(np.int64)
        sums = [np.bincount(at, w[used], total) for w in (low, high)]
        filled = np.bincount(at, rare[used], total) > 0
        part_owner = np.repeat(np.arange(len(sizes)), count)
        blank = np.bincount(part_owner, ~filled, len(sizes))
        use = filled | (blank > bands.spare[np.maximum(group, 0)])[part_owner]
        with np.errstate(over="ignore"):
            body = (sums[1].astype(np.uint64) << np.uint64(32)) + sums[0].astype(np.uint64)
            place = (np.arange(total) - start[part_owner]).astype(np.uint64) + (group[part_owner].astype(np.uint64) << np.uint64(32))
            key = mix(body + mix(place + GOLD))
        keys.append(key[use])
        owners.append(part_owner[use])
    return np.concatenate([*keys, np.empty(0, np.uint64)]), np.concatenate([*owners, np.empty(0, np.int64)]).astype(np.int64)


SIGNED = "doc_id long, n long, f1 long, f2 long, chunk int, counts binary"


def sign(docs: DataFrame, n: int) -> DataFrame:
    """For each row its size and digest; and the counters of each map task, in chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = np.zeros(COUNTERS, dtype=np.int64)
        names = ["doc_id", "n", "f1", "f2", "chunk", "counts"]
        for batch in by_bytes(batches):
            flat, sizes = shingle_sets(batch.column("text"), n)
            counters += np.bincount((flat & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            both, full = [], np.flatnonzero(sizes)
            for salt in (GOLD, ~GOLD):
                sums = np.zeros(len(sizes), dtype=np.uint64)
                if len(full):
                    sums[full] = np.add.reduceat(mix(flat ^ salt), (np.cumsum(sizes) - sizes)[full])
                both.append(pa.array(sums.view(np.int64)))
            none = pa.nulls(batch.num_rows, pa.int32()), pa.nulls(batch.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), *both, *none], names=names)
        parts = np.split(counters.astype("<i8"), CHUNKS)
        void = [pa.nulls(CHUNKS, pa.int64())] * 4
        yield pa.RecordBatch.from_arrays([*void, pa.array(range(CHUNKS), pa.int32()), pa.array([p.tobytes() for p in parts], pa.binary())], names=names)

    return docs.transform(in_batches, run, SIGNED)


def common_shingles(signed: DataFrame) -> np.ndarray:
    """Which of the 2^18 counters stand far above the mean."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                total[chunk] = total.get(chunk, 0) + np.frombuffer(body.as_buffer(), dtype="<i8")
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["chunk", "counts"])

    rows = signed.filter("chunk is not null").select("chunk", "counts").repartition(CHUNKS, "chunk").mapInArrow(add, "chunk int, counts binary").collect()  # 16 rows
    counters = np.zeros(COUNTERS, dtype=np.int64)
    for r in rows:
        width = COUNTERS // CHUNKS
        counters[r["chunk"] * width : (r["chunk"] + 1) * width] = np.frombuffer(r["counts"], dtype="<i8")
    mean = counters.mean()
    return counters > mean + 8 * np.sqrt(mean) + 32


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of these edges, sorted, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        left, right = label[x], label[y]
        low = np.minimum(left, right)
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        while (label[label] != label).any():
            label = label[label]
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
    return nodes, nodes[label]


def star_rows(pairs: list[np.ndarray]) -> pa.RecordBatch:
    """Edges (a, b) from the smallest node of each part of these edges (arrays of two rows) to all its others."""
    both = np.concatenate(pairs, axis=1)
    nodes, low = smallest_reachable(both[0], both[1])
    apart = nodes != low
    return pa.RecordBatch.from_arrays([pa.array(low[apart]), pa.array(nodes[apart])], names=["a", "b"])


def prefix_keys(flat: np.ndarray, sizes: np.ndarray, percent: int, counters: np.ndarray, more: np.ndarray | int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of each set's prefix that some other row may hold, and the position of their set. ``counters``: rows by
    shingle hash, at most 255; a counter of 1 means that no other row holds the shingle. ``more``: by how many shingles each prefix is longer."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    held = counters[(flat & np.uint64(len(counters) - 1)).astype(np.int64)]
    order = np.lexsort((mix(flat + GOLD), held, owner))
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    first = place < (sizes + 1 + -sizes * percent // 100 + more)[owner]
    picked = order[first & (held[order] > 1)]
    return flat[picked], owner[picked]


def packed(counters: np.ndarray) -> bytes:
    """Counters of a byte each: all of them, or the places (uint32) and values of those that are not zero, whichever is shorter."""
    at = np.flatnonzero(counters)
    return counters.tobytes() if 5 * len(at) >= len(counters) else at.astype("<u4").tobytes() + counters[at].tobytes()


def add_packed(total: np.ndarray, body: bytes) -> None:
    """Adds packed counters to ``total``, where they stop at 255."""
    if len(body) == len(total):
        at, more = slice(None), np.frombuffer(body, dtype=np.uint8)
    else:
        n = len(body) // 5
        at, more = np.frombuffer(body, dtype="<u4", count=n), np.frombuffer(body, dtype=np.uint8, offset=4 * n)
    total[at] += np.minimum(more, 255 - total[at])


def task_counters(docs: DataFrame, n: int, width: int) -> DataFrame:
    """chunk, counts: what each map task counted, in at most CHUNKS rows, however many shingles and texts it has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width, dtype=np.uint8)
        for batch in by_bytes(batches):
            spots = (shingle_sets(batch.column("text"), n)[0] & np.uint64(width - 1)).astype(np.int64)
            at, times = np.unique(spots, return_counts=True)
            total[at] += np.minimum(times, 255 - total[at]).astype(np.uint8)
        parts = {i: part for i, part in enumerate(np.split(total, CHUNKS)) if part.any()}
        yield pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int32()), pa.array([packed(x) for x in parts.values()], pa.binary())], names=["chunk", "counts"])

    return docs.transform(in_batches, run, "chunk int, counts binary")


def shingle_counters(docs: DataFrame, n: int, width: int) -> np.ndarray:
    """How many rows hold a shingle of each hash (``width`` of them, a power of two), up to 255."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, body in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                add_packed(total.setdefault(chunk, np.zeros(width // CHUNKS, dtype=np.uint8)), body.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(x) for x in total.values()], pa.binary())], names=["chunk", "counts"])

    counters = np.zeros(width, dtype=np.uint8)
    for r in task_counters(docs, n, width).repartition(CHUNKS, "chunk").transform(in_batches, add, "chunk int, counts binary").collect():  # CHUNKS rows
        add_packed(counters.reshape(CHUNKS, -1)[r["chunk"]], r["counts"])
    return counters


def parted(docs: DataFrame, members: DataFrame, n: int, percent: int, tile_docs: int) -> DataFrame:
    """members (doc_id, comp, n) with components of more than one block parted by prefixes; what shares no prefix goes. Where
    the counters are too few for them, they are parted by longer prefixes first, as long as that takes a tenth of their shingles."""
    before = None
    while True:
        cost = members.groupBy("comp").agg((F.sum(F.greatest(F.col("n"), F.lit(LEAST_COST))) / (tile_docs * LEAST_COST)).alias("cost"))
        large = stored(members.join(cost.filter("cost > 1").select("comp"), "comp", "left_semi").select("doc_id", "comp", "n"), "large")
        shingles = large.agg(F.sum("n").alias("n")).first()["n"]
        crowded = shingles is not None and 4 * shingles > ORDER_BYTES
        if shingles is None or (crowded and before is not None and 10 * shingles > 9 * before):
            discard(large)
            return members
        _, few = split_by_ids(docs.select("doc_id", "text"), large)
        texts = stored(few.join(large.select("doc_id", "comp").distinct(), "doc_id"), "large-texts")
        width = min(ORDER_BYTES, 1 << max(16, int(4 * shingles).bit_length()))
        shared = docs.sparkSession.sparkContext.broadcast(shingle_counters(texts.select("doc_id", "text"), n, width))
        if crowded:
            edges = firm_edges(texts, n, percent, shared)
        else:
            edges = tied_edges(texts.select("doc_id", "text"), lambda column: prefix_keys(*shingle_sets(column, n), percent, shared.value))  # noqa: B023
        near = components(edges).select(F.col("node").alias("doc_id"), F.col("comp").alias("near"))
        fine = stored(large.join(near, "doc_id").select("doc_id", F.xxhash64("comp", "near").alias("comp"), "n"), "parted")
        whole = members.join(large.select("comp").distinct(), "comp", "left_anti").select("doc_id", "comp", "n")
        out = stored(whole.unionByName(fine), "members")
        discard(large, texts, fine)
        shared.unpersist()
        if not crowded:
            return out
        before, members = shingles, out


def firm_edges(texts: DataFrame, n: int, percent: int, shared: Broadcast) -> DataFrame:
    """Edges (a, b) whose components hold every link within a ``comp`` of texts (doc_id, text, comp).

    The documents of a key (a shingle of a longer prefix, and the component) meet the smallest of them, the lead. Linked documents share more than
    twice as many keys as either may leave (``room``, of its size cut to the least that can link), so one key joins both to its lead: a document leaves
    the leads that it met under the fewest keys while these keys, together, are within its room.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            flat, sizes = shingle_sets(batch.column("text"), n)
            key, owner = prefix_keys(flat, sizes, percent, shared.value, sizes // LONGER)
            ids, comps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "comp"))
            key = mix(key ^ mix(comps.view(np.uint64) * GOLD + np.uint64(5))[owner]).view(np.int64)
            columns = key, ids[owner], (percent * sizes // 100 // LONGER // 2).astype(np.int32)[owner]
            for i in range(0, len(key), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["key", "doc", "room"])

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        lead, doc, room = np.concatenate(held, axis=1)
        order = np.lexsort((lead, doc))
        lead, doc, room = lead[order], doc[order], room[order]
        first = np.flatnonzero(np.concatenate([[True], (lead[1:] != lead[:-1]) | (doc[1:] != doc[:-1])]))
        columns = lead[first], doc[first], np.diff(np.append(first, len(lead))), np.minimum.reduceat(room, first)
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "times", "room"])

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            new = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lead = np.where(first < 0, doc[0] if last is None else last[1], doc[np.maximum(first, 0)])
            last = key[-1], lead[-1]
            apart = lead != doc
            if apart.any():
                held.append(np.stack([lead[apart], doc[apart], batch.column("room").to_numpy()[apart].astype(np.int64)]))
                size += held[-1].shape[1]
            if size > 4 * TASK_EDGES:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    rows = texts.transform(in_batches, keyed, "key long, doc long, room int")
    pairs = rows.repartition("key").sortWithinPartitions("key", "doc").transform(in_batches, met, "a long, b long, times long, room long")
    each = pairs.groupBy("a", "b").agg(F.sum("times").alias("times"), F.min("room").alias("room"))
    whole = Window.partitionBy("b")
    return each.withColumns({"gone": F.sum("times").over(whole.orderBy("times", "a")), "room": F.min("room").over(whole)}).filter("gone > room").select("a", "b")


def candidate_edges(docs: DataFrame, n: int, percent: int, common: np.ndarray) -> DataFrame:
    """Edges (a, b), a < b, whose components hold every link."""
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(common))
    bands: list[Bands] = []

    def keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not bands:
            bands.append(Bands(percent))
        return part_keys(*shingle_sets(column, n), bands[0], np.unpackbits(shared.value).astype(bool))

    return tied_edges(docs, keys)


def tied_edges(docs: DataFrame, keys: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Edges (a, b), a < b, that join all documents of a key; ``keys`` of texts: keys and the position of the text each belongs to.
    A map task ties documents of one key in a batch itself, and passes
    on the key with one of them: so a key that very many documents share has few rows where it meets."""

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            key, owner = keys(batch.column("text"))
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            key, doc = key[order], ids[owner[order]]
            new = np.concatenate([[True], key[1:] != key[:-1]])
            lead = doc[np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))]
            apart = lead != doc
            nodes, low = smallest_reachable(lead[apart], doc[apart])
            # documents tied here meet again under a key that their smallest one alone has
            tied = mix(low.astype(np.int64).view(np.uint64) * GOLD + np.uint64(3))
            columns = np.concatenate([key[new], tied]).view(np.int64), np.concatenate([lead[new], nodes])
            for i in range(0, len(columns[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 16)]) for c in columns], names=["key", "doc"])

    def tied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pairs, size = None, [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, doc = batch.column("key").to_numpy(), batch.column("doc").to_numpy()
            new = np.concatenate([[last is None or key[0] != last[0]], key[1:] != key[:-1]])
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            lead = np.where(first < 0, doc[0] if last is None else last[1], doc[np.maximum(first, 0)])
            last = key[-1], lead[-1]
            apart = lead != doc
            if apart.any():
                pairs.append(np.stack([lead[apart], doc[apart]]))
                size += pairs[-1].shape[1]
            if size > TASK_EDGES:
                yield star_rows(pairs)
                pairs, size = [], 0
        if size:
            yield star_rows(pairs)

    rows = docs.transform(in_batches, keyed, "key long, doc long")
    return rows.repartition("key").sortWithinPartitions("key").transform(in_batches, tied, "a long, b long")


def stars(edges: DataFrame, tasks: int) -> DataFrame:
    """Fewer edges (a, b) with the same components: each task turns those it holds into stars around smallest nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(np.stack([batch.column("a").to_numpy(), batch.column("b").to_numpy()]))
            size += batch.num_rows
            if size > 2 * TASK_EDGES:  # only where tasks are uneven
                yield star_rows(held)
                held, size = [], 0
        if size:
            yield star_rows(held)

    return edges.select("a", "b").coalesce(tasks).transform(in_batches, run, "a long, b long")


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """node, comp (the smallest node reachable), for every node of an edge (a, b). What fits one task is solved there; else each
    task makes stars of its own edges, and rounds of joins go on from those. Both give the same."""
    first = stored(edges.select("a", "b").filter("a != b"), "edges")
    tasks = first.count() // task_edges + 1
    fewer = stored(stars(first, tasks), "stars")
    if tasks == 1:
        discard(first)
        return fewer.select(F.col("b").alias("node"), F.col("a").alias("comp")).unionByName(fewer.select(F.col("a").alias("node"), F.col("a").alias("comp")).distinct())
    both = stored(fewer.union(fewer.select("b", "a")).distinct(), "edges")
    discard(first, fewer)
    labels = stored(both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("comp"), F.lit(True).alias("moved")), "labels")
    while True:
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy("a").agg(F.min("comp").alias("low"))
        hooked = labels.join(heard.withColumnRenamed("a", "node"), "node").select("node", F.col("comp").alias("was"), F.least("comp", "low").alias("comp"))
        above = labels.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        jumped = hooked.join(above, "comp", "left").select("node", F.least("comp", F.coalesce("up", "comp")).alias("comp"), "was")
        before, labels = labels, stored(jumped.select("node", "comp", (F.col("comp") < F.col("was")).alias("moved")), "labels")
        discard(before)
        if labels.filter("moved").isEmpty():
            discard(both)
            return labels.select("node", "comp")


# ---- tiles ----


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """Hashed bitmaps of one width: about one bit for each shingle of the largest set, 64 to 16,384 bits."""
    most = max(len(s) for s in sets)
    bits = 1 << min(14, max(6, int(np.ceil(np.log2(max(1, most) * 1.5)))))
    flat = np.concatenate(sets)
    out = np.zeros((len(sets), bits // 64), dtype=np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    spot = (mix(flat) % np.uint64(bits)).astype(np.int64)
    np.bitwise_or.at(out, (owner, spot // 64), np.uint64(1) << (spot % 64).astype(np.uint64))
    return out


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = len(y) - 1
    return int(np.count_nonzero(y[at] == x))


def tile_links(ids: list[int], sides: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links of a tile: among all (one side) or between side 0 and side 1."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, sides, sets = [ids[i] for i in order], sides[order], [sets[i] for i in order]
    sizes = np.array([len(s) for s in sets])
    forest, links, bits = Forest(len(ids)), [], bitmaps(sets)
    two = bool(sides.any())
    seen: dict[int, int] = {}
    for i, x in enumerate(ids):  # rows of one document
        if seen.setdefault(x, i) != i:
            forest.join(seen[x], i)
    step = max(1, (1 << 21) // (len(ids) * bits.shape[1]))
    for a in range(0, len(ids), step):
        b = min(len(ids), a + step)
        end = int(np.searchsorted(sizes, 100 * sizes[b - 1] // percent, side="right"))
        apart = np.bitwise_count(bits[a:b, None, :] ^ bits[None, a:end, :]).sum(axis=2, dtype=np.int64)
        both = sizes[a:b, None] + sizes[None, a:end]
        need = -(-percent * both // (100 + percent))
        possible = ((both - apart) // 2 >= need) & (np.minimum(sizes[a:b, None], sizes[None, a:end]) >= need)
        possible &= np.arange(a, b)[:, None] < np.arange(a, end)[None, :]
        if two:
            possible &= sides[a:b, None] != sides[None, a:end]
        rows, cols = np.nonzero(possible)
        best = np.argsort(apart[rows, cols] / both[rows, cols], kind="stable")
        for i, j in zip((rows[best] + a).tolist(), (cols[best] + a).tolist(), strict=True):
            if forest.root(i) == forest.root(j):
                continue
            common = overlap(sets[i], sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                forest.join(i, j)
                links.append((ids[i], ids[j]))
    return links


def in_blocks(members: DataFrame, group: list[str], tile_docs: int) -> DataFrame:
    """members (doc_id, n, group columns) with ``block``: runs of a group by size that hold about ``tile_docs`` small sets, or as
    many shingles in fewer large ones; ``all``: rows of the group; ``cost``: that of the whole group, in blocks."""
    each = F.greatest(F.col("n"), F.lit(LEAST_COST))
    counts = members.groupBy(*group, "n").agg(F.count(F.lit(1)).alias("of"))
    by_size, whole = Window.partitionBy(*group).orderBy("n"), Window.partitionBy(*group)
    room = tile_docs * LEAST_COST
    placed = counts.withColumns({"before": F.sum(F.col("of") * each).over(by_size) - F.col("of") * each, "all": F.sum("of").over(whole), "cost": F.sum(F.col("of") * each).over(whole) / room})
    placed = stored(placed, "sizes")  # so that the join below deals out by size too, and a large group can be split
    block = F.floor((F.col("before") + F.pmod(F.xxhash64("doc_id"), F.col("of")) * each) / F.lit(room)).cast("int")
    return members.join(placed, [*group, "n"]).select("doc_id", *group, "n", "all", "cost", block.alias("block"))


def first_tiles(members: DataFrame, tile_docs: int) -> DataFrame:
    """doc_id, n, tile, side: a tile for each block of each component (doc_id, comp, n); in a component of several blocks one
    document, the pivot, is in all of them, so that a group of near copies comes together in this round."""
    blocked = in_blocks(members, ["comp"], tile_docs).filter("all > 1").withColumn("tile", F.xxhash64("comp", "block"))
    large = blocked.filter("cost > 1")
    pivots = large.groupBy("comp").agg(F.min_by(F.struct("doc_id", "n"), F.struct(F.xxhash64("doc_id"), F.col("doc_id"), F.col("n"))).alias("p"))
    more = large.select("comp", "tile").distinct().join(pivots, "comp").select("p.doc_id", "p.n", "tile")
    return blocked.select("doc_id", "n", "tile").unionByName(more).distinct().withColumn("side", F.lit(0))


def second_tiles(members: DataFrame, joined: DataFrame, percent: int, tile_docs: int) -> DataFrame:
    """Tiles for what the first round may have left apart in components of several blocks: documents outside a
    component's largest joined part meet all its other documents, block by block, where sizes can link; the largest
    part is one already and does not meet itself."""
    sizes = members.groupBy("comp").agg((F.sum(F.greatest(F.col("n"), F.lit(LEAST_COST))) / (tile_docs * LEAST_COST)).alias("cost")).filter("cost > 1")
    large = members.join(stored(sizes.select("comp"), "large"), "comp", "left_semi")
    placed = large.join(joined.select(F.col("node").alias("doc_id"), F.col("comp").alias("part")), "doc_id", "left").withColumn("part", F.coalesce("part", "doc_id"))
    most = placed.groupBy("comp", "part").agg(F.count(F.lit(1)).alias("of")).groupBy("comp").agg(F.max_by("part", F.struct(F.col("of"), F.col("part"))).alias("most"))
    marked = placed.join(stored(most, "most"), "comp").select("doc_id", "comp", "n", (F.col("part") == F.col("most")).alias("whole"))
    blocked = stored(in_blocks(stored(marked, "marked"), ["comp", "whole"], tile_docs), "blocked")
    ends = blocked.groupBy("comp", "whole", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    one = ends.filter("not whole").select("comp", F.col("block").alias("i"), F.col("lo").alias("lo_i"), F.col("hi").alias("hi_i"))
    two = ends.select("comp", "whole", F.col("block").alias("j"), F.col("lo").alias("lo_j"), F.col("hi").alias("hi_j"))
    near = (100 * F.col("hi_i") >= percent * F.col("lo_j")) & (100 * F.col("hi_j") >= percent * F.col("lo_i"))
    pairs = one.join(two, "comp").filter(near & (F.col("whole") | (F.col("i") <= F.col("j"))))
    at = lambda whole, block, side: F.struct(whole.alias("whole"), F.col(block).alias("block"), F.lit(side).alias("side"))
    own = at(F.lit(False), "i", 0)
    sides = F.when(~F.col("whole") & (F.col("i") == F.col("j")), F.array(own)).otherwise(F.array(own, at(F.col("whole"), "j", 1)))
    listed = pairs.select("comp", F.xxhash64("comp", "whole", "i", "j").alias("tile"), F.explode(sides).alias("s")).select("comp", "tile", "s.whole", "s.block", "s.side")
    return blocked.join(stored(listed, "listed"), ["comp", "whole", "block"]).select("doc_id", "n", "tile", "side")


# ---- id filters ----

#: Bits of an id filter: at most 2^20 rows of 64. A filter that is too full lets more rows through, never fewer.
FILTER_BITS = 1 << 26


def split_by_ids(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows whose doc_id is certainly not among ``ids`` (null ids are among these), and all others. The filter is a broadcast
    table of at most FILTER_BITS / 64 rows, whatever the number of ids, so rows with long texts need not be shuffled to find out."""
    word, bits = (f"_{c}_{uuid.uuid4().hex}" for c in ("word", "bits"))
    spot = F.xxhash64(F.col("doc_id").cast("long")).bitwiseAND(F.lit(FILTER_BITS - 1))
    marks = ids.select(spot.alias("s")).groupBy(F.shiftright("s", 6).alias(word)).agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias(bits))
    met = rows.withColumn(word, F.when(F.col("doc_id").isNotNull(), F.shiftright(spot, 6))).join(F.broadcast(stored(marks, "id-filter")), word, "left")
    may = F.coalesce(F.getbit(F.col(bits), spot.bitwiseAND(F.lit(63)).cast("int")), F.lit(0)) == 1
    return tuple(met.filter(c).select(rows.columns) for c in (~may, may))


def without(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among ``ids``."""
    sure, doubtful = split_by_ids(rows, ids)
    return sure.unionByName(doubtful.join(ids.select("doc_id"), "doc_id", "left_anti").select(rows.columns))


def links(docs: DataFrame, tiles: DataFrame, n: int, percent: int) -> DataFrame:
    """Verified links (a, b) of all tiles."""

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches):
            sizes = shingle_sets(batch.column("text"), n)[1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes.astype(np.int64)), batch.column("text")], names=["doc_id", "n", "text"])

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            found = tile_links([r[2] for r in held], np.array([r[1] for r in held]), [r[3] for r in held], percent) if len(held) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], names=["a", "b"])

        for batch in by_bytes(batches):
            flat, sizes = shingle_sets(batch.column("text"), n)
            for row in zip(*(batch.column(c).to_pylist() for c in ("tile", "side", "doc_id")), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
                if held and held[0][0] != row[0]:
                    yield done()
                    held = []
                held.append(row)
        if held:
            yield done()

    _, few = split_by_ids(docs.select("doc_id", "text"), tiles)  # most texts stay where they are
    asked = few.transform(in_batches, sized, "doc_id long, n long, text string").join(tiles, ["doc_id", "n"])  # a text is shorter than its set
    return asked.select("tile", "side", "doc_id", "text").repartition("tile").sortWithinPartitions("tile").transform(in_batches, solve, "a long, b long")


def join(docs: DataFrame, n: int = 3, percent: int = 90, tile_docs: int = 256) -> DataFrame:
    """doc_id, n_shingles, component_id of every row. See the module's text."""
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed = stored(sign(read, n), "signed")
    rows = signed.filter("chunk is null").select("doc_id", "n", "f1", "f2")
    named = read.filter("doc_id is not null")
    full = rows.filter("doc_id is not null and n > 0")
    classes = stored(full.groupBy("n", "f1", "f2").agg(F.min("doc_id").alias("rep"), F.max("doc_id").alias("top")).filter("rep < top").drop("top"), "classes")
    copies = stored(full.join(classes, ["n", "f1", "f2"]).filter("doc_id != rep").select("doc_id", "rep").distinct(), "copies")
    same = copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    # from here on one document stands for its copies; a document of several different rows is never left out
    digests = full.groupBy("doc_id").agg(*(g(c).alias(f"{g.__name__}_{c}") for c in ("n", "f1", "f2") for g in (F.min, F.max)))
    alike = digests.filter("min_n = max_n and min_f1 = max_f1 and min_f2 = max_f2").select("doc_id")
    left_out = stored(copies.join(alike, "doc_id", "left_semi").select("doc_id").distinct(), "left-out")
    edges = stored(candidate_edges(without(named, left_out), n, percent, common_shingles(signed)), "candidates")
    near = components(edges.unionByName(same))
    sizes = full.select("doc_id", "n").distinct()  # a row for each size that a document has
    members = near.withColumnRenamed("node", "doc_id").join(left_out, "doc_id", "left_anti").join(sizes, "doc_id").select("doc_id", "comp", "n")
    members = parted(named, stored(members, "members"), n, percent, tile_docs)
    discard(edges, classes)
    found = stored(links(named, stored(first_tiles(members, tile_docs), "tiles"), n, percent), "links")
    cost = members.groupBy("comp").agg(F.sum(F.greatest(F.col("n"), F.lit(LEAST_COST))).alias("cost"))
    if not cost.filter(F.col("cost") > tile_docs * LEAST_COST).isEmpty():
        tiles = stored(second_tiles(members, components(found), percent, tile_docs), "tiles")
        found = found.unionByName(stored(links(named, tiles, n, percent), "links"))
    final = components(found.unionByName(same))
    out = rows.join(final.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("comp", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without those linked to a document of smaller doc_id; all columns stay."""
    gone = stored(join(docs, n, percent).filter("component_id < doc_id").select("doc_id").distinct(), "gone")
    return without(docs, gone)


#: DuckDB SQL for join() with n = 3 and percent = 90 over `documents`: all pairs that share a shingle, and the closure of the links.
ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(words) >= 3 THEN list_distinct(list_transform(range(1, len(words) - 1), lambda i: words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2]))
         WHEN len(words) > 0 THEN [array_to_string(words, chr(31))] ELSE [] END AS g FROM w),
z AS (SELECT doc_id, len(g)::BIGINT AS n FROM s),
u AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN z a ON a.doc_id = x JOIN z b ON b.doc_id = y WHERE 100 * c >= 90 * (a.n + b.n - c)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS low FROM r GROUP BY x)
SELECT z.doc_id, z.n AS n_shingles, least(z.doc_id, coalesce(m.low, z.doc_id)) AS component_id FROM z LEFT JOIN m ON m.x = z.doc_id
"""
