"""Language-model scores from a log-frequency Bloom filter.

Learning counts tokens and pairs of neighbouring tokens over all learning rows (summed in each map task first). The
``held`` most frequent tokens keep exact counts in a broadcast table of bounded size; any other token's exact
count is joined by shuffle, where such tokens are rare by definition. A pair seen c times, of whatever tokens, has
the level q = 1 + floor(log2(c)), and the filter holds (pair, 1), ..., (pair, q) at ``bits`` each. That is ``least`` = 1, which
``Params.whole()`` and op3_lm take; with ``least`` = 2 pairs seen once are left out and q = 1 + floor(log2(c - 1)). The filter grows
with its entries and is cut by pair hash into segments of bounded size. While all of it is at most ``broadcast_bytes``, it
is broadcast and probed where the texts are. Beyond, as many segments as fit are, and nothing unbounded is broadcast or held: each batch of texts sends
its distinct pairs of the other segments to these, which answer with levels (one exchange there, one back), so the work stays in proportion
to the text. The batches are written as compressed texts, in buckets by task, so that levels come to them and texts are not exchanged; a pair travels in 5 bytes and its level in one, and token streams are made anew
where they are needed. Pairs are counted packed too, in slices by their lowest bits, from which the filter is filled without another exchange. Both ways probe the same bits and give the same scores.

Scoring probes (pair, 1), (pair, 2), ... until a miss, and interpolates

    p(w | v) = (1 - weight) * (c(w) + 1) / (N + V + 1) + weight * min(1, level's count / c(v))

Tokens: lower-cased words ``[^\\x20\\x09-\\x0D]+`` and one end; the first word follows a begin mark.

Defined results: a null or empty text is the end alone; without learning rows every token has probability 1 at the
base; equal ids and repeated rows are scored row by row; a null doc_id is never held out; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, bucket_numbers, by_bytes, discard, in_batches, mix, stored, word_hashes

END, BEGIN = np.uint64(0x5EED_0000_0000_0001), np.uint64(0x5EED_0000_0000_0002)
#: Segments of the filter, at least; a power of two.
SEGMENTS = 256
#: Entries of a segment, about; beyond, there are more segments.
SEGMENT_ENTRIES = 1 << 20
#: Groups of segments that pairs are sent to, at most; a power of two.
GROUPS = 4096
PROBES = 7
#: Bits of a pair's hash. Of 2.5 billion pairs one in 100,000 meets another's hash, far fewer than the filter's false hits.
PAIR_BITS = 48
#: Counts a map task holds before it passes them on.
HELD = 800_000


@dataclass(frozen=True)
class Params:
    bits: int = 14
    weight: float = 0.1
    held: int = 1 << 20
    broadcast_bytes: int = 64 << 20
    #: The smallest count, 1 or 2, of a pair that the filter holds.
    least: int = 2

    @classmethod
    def whole(cls, **more) -> Params:
        """Every pair is held, those seen once too."""
        return cls(least=1, **more)


@dataclass
class Model:
    tokens: int  # N
    types: int  # V
    texts: int
    heads: np.ndarray  # sorted hashes
    counts: np.ndarray
    segments: int
    weight: float
    filter: np.ndarray | None = None  # segments x bytes, those that are broadcast: the first
    least: int = 2

    def count(self, hashes: np.ndarray) -> np.ndarray:
        """Exact counts of held tokens, -1 for others."""
        if not len(self.heads):
            return np.full(len(hashes), -1, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.heads, hashes), len(self.heads) - 1)
        return np.where(self.heads[at] == hashes, self.counts[at], -1)

    def segment(self, pairs: np.ndarray) -> np.ndarray:
        return (pairs & np.uint64(self.segments - 1)).astype(np.int64)

    def whole(self) -> bool:
        return len(self.filter) == self.segments

    def held(self, pairs: np.ndarray) -> np.ndarray:
        """Whether a pair's segment is broadcast."""
        return self.segment(pairs) < len(self.filter)

    def level(self, pairs: np.ndarray) -> np.ndarray:
        """Levels by repeated membership probes; 0 for a pair that the filter does not hold."""
        return probe(self.filter, self.segment(pairs), pairs)


def probe(bodies: np.ndarray, rows: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The levels of pairs, each in its row of ``bodies`` (segments x bytes)."""
    out, left, j = np.zeros(len(pairs), dtype=np.int64), np.arange(len(pairs)), 1
    width = bodies.shape[1]
    while len(left) and width:
        rest = []
        for part in np.array_split(left, -(-len(left) // (1 << 16))):
            spots = places(pairs[part], j, width * 8)
            hit = bodies[rows[part][:, None], spots >> 3] >> (spots & 7).astype(np.uint8) & 1
            rest.append(part[hit.all(axis=1)])
        left = np.concatenate(rest)
        out[left] = j
        j += 1
    return out


def level_count(level: np.ndarray, least: int) -> np.ndarray:
    """The middle, by ratio, of the counts of a level: from 2^(q-1) to 2^q - 1, all one higher where ``least`` is 2."""
    return np.sqrt((2.0 ** (level - 1) + least - 1) * (2.0**level + least - 2))


def places(pairs: np.ndarray, level: int, bits: int) -> np.ndarray:
    """The PROBES bit places of (pair, level) in its segment."""
    with np.errstate(over="ignore"):
        a = mix(pairs + np.uint64(level) * GOLD)
        b = mix(a + GOLD) | np.uint64(1)
        spots = (a[:, None] + np.arange(PROBES, dtype=np.uint64)[None, :] * b[:, None]) % np.uint64(bits)
    return spots.astype(np.int64)


def token_stream(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, each with its end, and the number of tokens of each."""
    words, counts = word_hashes(texts)
    sizes = counts + 1
    stream, ends = np.empty(len(words) + len(sizes), dtype=np.uint64), np.cumsum(sizes) - 1
    inside = np.ones(len(stream), dtype=bool)
    inside[ends] = False
    stream[inside], stream[ends] = words, END
    return stream, sizes


def pair_hashes(stream: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token the token before it (or the begin mark), and the hash of both, of PAIR_BITS."""
    before = np.concatenate([np.array([BEGIN]), stream[:-1]])[: len(stream)]
    before[np.cumsum(sizes)[:-1]] = BEGIN
    with np.errstate(over="ignore"):
        return before, mix(mix(before * GOLD) + stream) >> np.uint64(64 - PAIR_BITS)


def summed(k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sums of their counts."""
    order = np.argsort(k, kind="stable")
    k, c = k[order], c[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    return k[first], np.add.reduceat(c, first)


class Counter:
    """Counts of hashes, merged by sorting, passed on in batches."""

    def __init__(self):
        self.keys, self.counts, self.size = [], [], 0

    def add(self, values: np.ndarray) -> None:
        k, c = np.unique(values, return_counts=True)
        self.keys.append(k)
        self.counts.append(c)
        self.size += len(k)

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        k, c = summed(np.concatenate(self.keys), np.concatenate(self.counts))
        self.keys, self.counts, self.size = [], [], 0
        return k, c

    def drain(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            k, c = self.merged()
            for i in range(0, len(k), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(k[i : i + (1 << 16)].view(np.int64)), pa.array(c[i : i + (1 << 16)])], names=["h", "c"])


def counted(docs: DataFrame) -> DataFrame:
    """h, c of every token of all rows. A map task has merged what it counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for batch in by_bytes(batches):
            counter.add(token_stream(batch.column("text"))[0])
            if counter.size > HELD:
                yield from counter.drain()
        yield from counter.drain()

    return docs.select("text").transform(in_batches, run, "h long, c long").repartition("h").groupBy("h").agg(F.sum("c").alias("c"))


def short(pairs: np.ndarray, known: int) -> bytes:
    """Pairs without their lowest ``known`` bits, in as few bytes each as hold the rest."""
    return (pairs >> np.uint64(known)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, : -(-(PAIR_BITS - known) // 8)].tobytes()


def long(body: bytes, known: int, low: int) -> np.ndarray:
    """The pairs of ``short``, whose lowest bits are ``low``."""
    width = -(-(PAIR_BITS - known) // 8)
    cells = np.zeros((len(body) // width, 8), dtype=np.uint8)
    cells[:, :width] = np.frombuffer(body, dtype=np.uint8).reshape(-1, width)
    return (cells.view("<u8").ravel().astype(np.uint64) << np.uint64(known)) | np.uint64(low)


def pair_levels(docs: DataFrame, least: int) -> DataFrame:
    """The pairs of neighbouring tokens seen ``least`` times or more and their levels, packed: a row for each slice (the lowest bits of
    a pair, as many as SEGMENTS has) and sub (the four bits above). Pairs meet in packed rows too, with a byte for a count under 255."""
    low, known = SEGMENTS.bit_length() - 1, SEGMENTS.bit_length() + 3

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()

        def drain() -> Iterator[pa.RecordBatch]:
            if not counter.size:
                return
            k, c = counter.merged()
            cell = ((k & np.uint64(SEGMENTS - 1)) << np.uint64(4) | k >> np.uint64(low) & np.uint64(15)).astype(np.uint16)
            order = np.argsort(cell, kind="stable")
            cell, k, c = cell[order], k[order], c[order]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            cuts = list(zip(starts.tolist(), [*starts[1:].tolist(), len(k)], strict=True))
            few = np.minimum(c, 255).astype(np.uint8)
            columns = [
                pa.array(cell[starts] >> 4, pa.int32()),
                pa.array(cell[starts] & 15, pa.int32()),
                pa.array([short(k[a:b], known) for a, b in cuts], pa.binary()),
                pa.array([few[a:b].tobytes() for a, b in cuts], pa.binary()),
                pa.array([c[a:b][few[a:b] == 255].astype("<i8").tobytes() for a, b in cuts], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["slice", "sub", "pairs", "few", "many"])

        for batch in by_bytes(batches):
            counter.add(pair_hashes(*token_stream(batch.column("text")))[1])
            if counter.size > HELD:
                yield from drain()
        yield from drain()

    def level(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def done() -> pa.RecordBatch:
            counts = []
            for _, few, many in held:
                c = np.frombuffer(few, dtype=np.uint8).astype(np.int64)
                c[c == 255] = np.frombuffer(many, dtype="<i8")
                counts.append(c)
            k, c = summed(long(b"".join(x[0] for x in held), known, at[0] | at[1] << low), np.concatenate(counts))
            k, c = k[c >= least], c[c >= least]
            q = np.frexp((c + 1 - least).astype(float))[1].astype(np.uint8)  # 1 + floor(log2)
            columns = [[at[0]], [at[1]], [short(k, known)], [q.tobytes()], [int(q.sum(dtype=np.int64))]]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64()), strict=True)], names=["slice", "sub", "pairs", "q", "entries"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("slice", "sub", "pairs", "few", "many")), strict=True):
                if at != row[:2]:
                    if held:
                        yield done()
                    at, held = row[:2], []
                held.append(row[2:])
        if held:
            yield done()

    sent = docs.select("text").transform(in_batches, count, "slice int, sub int, pairs binary, few binary, many binary")
    return sent.repartition("slice").sortWithinPartitions("slice", "sub").transform(in_batches, level, "slice int, sub int, pairs binary, q binary, entries long")


def bloom(levels: DataFrame, params: Params) -> tuple[DataFrame, int, int]:
    """The filter (segment, body), its number of segments and the bytes of each. A segment may come in several rows, whose bits add up."""
    entries = levels.agg(F.coalesce(F.sum("entries"), F.lit(0)).alias("n")).first()["n"]
    segments = SEGMENTS
    while segments * SEGMENT_ENTRIES < entries:
        segments *= 2
    width = -(-entries * params.bits // (8 * segments)) + 64 if entries else 0
    low, known = SEGMENTS.bit_length() - 1, SEGMENTS.bit_length() + 3

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, {}  # segments of the slice at hand

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["segment", "body"])

        for batch in batches:
            for part, sub, body, q in zip(*(batch.column(c).to_pylist() for c in ("slice", "sub", "pairs", "q")), strict=True):
                if at != part:
                    if held:
                        yield done()
                    at, held = part, {}
                pairs, q = long(body, known, part | sub << low), np.frombuffer(q, dtype=np.uint8)
                whose = (pairs & np.uint64(segments - 1)).astype(np.int64)
                for segment in np.unique(whose).tolist():
                    own = whose == segment
                    mine, deep = pairs[own], q[own]
                    bits = np.zeros(width * 8, dtype=bool)
                    for j in range(1, int(deep.max()) + 1):
                        bits[places(mine[deep >= j], j, width * 8).ravel()] = True
                    bits = np.packbits(bits, bitorder="little")
                    held[segment] = held[segment] | bits if segment in held else bits
        if held:
            yield done()

    return stored(levels.select("slice", "sub", "pairs", "q").transform(in_batches, fill, "segment int, body binary"), "filter"), segments, width


def learn(docs: DataFrame, params: Params) -> tuple[Model, DataFrame, DataFrame]:
    """The model of all rows, the table of all token counts (h, c), and the filter (segment, body)."""
    counts = stored(counted(docs), "token-counts")
    rare = [1, 2, 3, 4, 6, 8, 12, 16, 24, *(2**k for k in range(5, 62))]
    ends = F.sum(F.when(F.col("h") == F.lit(int(END)), F.col("c")))
    sums = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v"), F.coalesce(ends, F.lit(0)).alias("texts"), *(F.count_if(F.col("c") >= t).alias(f"t{t}") for t in rare)).first()
    limit = next(t for t in rare if sums[f"t{t}"] <= params.held)
    head = counts.filter(F.col("c") >= limit).toArrow()  # at most ``held`` rows
    hashes, c = head.column("h").to_numpy().view(np.uint64), head.column("c").to_numpy()
    order = np.argsort(hashes)
    levels = stored(pair_levels(docs, params.least), "pair-levels")
    rows, segments, width = bloom(levels, params)
    discard(levels)
    model = Model(sums["n"], sums["v"], sums["texts"], hashes[order], c[order], segments, params.weight, least=params.least)
    here = segments if segments * width <= params.broadcast_bytes else params.broadcast_bytes // width
    model.filter = np.zeros((here, width), dtype=np.uint8)
    for batch in rows.filter(F.col("segment") < here).toArrow().to_batches():  # at most ``broadcast_bytes``
        for segment, body in zip(batch.column("segment").to_pylist(), batch.column("body"), strict=True):
            model.filter[segment] |= np.frombuffer(body.as_buffer(), dtype=np.uint8)
    return model, counts, rows


SCORED = "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, rare array<long>, times array<long>, far array<struct<v:long,w:long,cv:long,cw:long,q:long>>"


def lists(owner: np.ndarray, texts: int) -> pa.Array:
    """Offsets of a list for each text, from the texts that own the values (in order)."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=texts))]).astype(np.int32))


def scored(m: Model, uid: np.ndarray, ids: pa.Array, held_out: pa.Array, stream: np.ndarray, sizes: np.ndarray, asked: np.ndarray, levels: np.ndarray) -> pa.RecordBatch:
    """Rows of SCORED for a batch of texts; ``levels`` are those of the distinct pairs ``asked`` (sorted)."""
    total, texts = m.tokens + m.types + 1, len(sizes)
    owner = np.repeat(np.arange(texts), sizes)
    distinct, place = np.unique(stream, return_inverse=True)
    count = m.count(distinct)[place]
    known = count > 0
    before, pairs = pair_hashes(stream, sizes)
    seen_before = np.where(before == BEGIN, m.texts, np.concatenate([[0], count[:-1]]))
    base = np.log10((np.maximum(count, 0) + 1) / total)
    level = levels[np.searchsorted(asked, pairs)] if len(asked) else np.zeros(len(stream), dtype=np.int64)
    p = (1 - m.weight) * 10**base
    near = known & (seen_before > 0)
    hit, beyond = np.flatnonzero((level > 0) & near), np.flatnonzero((level > 0) & ~near)
    p[hit] += m.weight * np.minimum(1.0, level_count(level[hit], m.least) / seen_before[hit])
    sums = [np.bincount(owner[known], w[known], texts).astype(float) for w in (base, np.log10(p))]
    other = np.flatnonzero(~known)
    other = other[np.lexsort((stream[other], owner[other]))]
    first = np.flatnonzero(np.concatenate([[True], (stream[other][1:] != stream[other][:-1]) | (owner[other][1:] != owner[other][:-1])])) if len(other) else np.empty(0, np.int64)
    times, at = np.diff(np.append(first, len(other))), lists(owner[other][first], texts)
    fields = {"v": before[beyond].view(np.int64), "w": stream[beyond].view(np.int64), "cv": seen_before[beyond], "cw": count[beyond], "q": level[beyond]}
    far = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in fields.values()], list(fields))
    columns = {
        "uid": pa.array(uid),
        "doc_id": ids,
        "held_out": held_out,
        "n_tokens": pa.array(sizes),
        "n_known": pa.array(np.bincount(owner[known], minlength=texts).astype(np.int64)),
        "base": pa.array(sums[0]),
        "score": pa.array(sums[1]),
        "rare": pa.ListArray.from_arrays(at, pa.array(stream[other][first].view(np.int64))),
        "times": pa.ListArray.from_arrays(at, pa.array(times.astype(np.int64))),
        "far": pa.ListArray.from_arrays(lists(owner[beyond], texts), far),
    }
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches with the number of their first row, unique in the table, and their token stream."""
    at = TaskContext.get().partitionId() << 40
    for batch in by_bytes(batches):
        yield at, batch, *token_stream(batch.column("text"))
        at += batch.num_rows


def score_here(docs: DataFrame, model: Model) -> DataFrame:
    """Scores from held tokens and a broadcast filter. The other tokens of each row as (rare, times); the pairs with such tokens
    that the filter holds as ``far``, with the counts that are known (-1 for others)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for at, batch, stream, sizes in numbered(batches):
            asked = np.unique(pair_hashes(stream, sizes)[1])
            yield scored(m, np.arange(at, at + len(sizes)), batch.column("doc_id"), batch.column("held_out"), stream, sizes, asked, m.level(asked))

    return docs.select("doc_id", "held_out", "text").transform(in_batches, run, SCORED)


#: Buckets of batches, at most.
MOST_BUCKETS = 4096
GATHERED = "batch long, texts array<string>, ids array<long>, held array<boolean>"
SENT = "batch long, part int, segment int, body binary"


def gathered(docs: DataFrame) -> DataFrame:
    """A row for each batch of texts, so that every later pass sees the same batches. A task takes numbers of one bucket."""
    docs = docs.select("doc_id", "held_out", "text")
    n = max(1, min(MOST_BUCKETS, docs.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        at = task << 40
        for batch in by_bytes(batches):
            while not len(own := np.flatnonzero(bucket_numbers(np.arange(at, at + 8 * n), n) == task % n)):
                at += 8 * n
            at += int(own[0])
            whole = [pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(c)) for c in ("text", "doc_id", "held_out")]
            yield pa.RecordBatch.from_arrays([pa.array([at]), *whole], names=["batch", "texts", "ids", "held"])
            at += batch.num_rows

    out = docs.transform(in_batches, run, GATHERED)
    out.scratch_buckets = ("batch", n)
    return out


def score_there(docs: DataFrame, model: Model, filter_rows: DataFrame) -> DataFrame:
    """The same rows, stored, where the filter is too large to broadcast: pairs travel to its segments, levels travel back."""
    shared, groups = docs.sparkSession.sparkContext.broadcast(model), min(GROUPS, model.segments)
    known = groups.bit_length() - 1  # bits that all pairs of a group share
    each = -(-(PAIR_BITS - known) // 8)

    def split(m: Model, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """An order of the pairs by group, and where each group ends."""
        group = m.segment(asked) & (groups - 1)
        return np.argsort(group.astype(np.uint16), kind="stable"), np.cumsum(np.bincount(group, minlength=groups))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for k, at in enumerate(batch.column("batch").to_pylist()):
                asked = np.unique(pair_hashes(*token_stream(batch.column("texts").slice(k, 1).flatten()))[1])
                asked = asked[~m.held(asked)]
                order, ends = split(m, asked)
                asked, starts = asked[order], np.concatenate([[0], ends[:-1]])
                full = np.flatnonzero(ends > starts)
                body = [short(asked[a:b], known) for a, b in zip(starts[full].tolist(), ends[full].tolist(), strict=True)]
                columns = [pa.array(np.full(len(full), at)), pa.array(full, pa.int32()), pa.nulls(len(full), pa.int32()), pa.array(body, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["batch", "part", "segment", "body"])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        part, bodies, place = None, [], {}
        asked: list[tuple[int, bytes]] = []  # what was asked of this group in this batch of rows

        def done() -> pa.RecordBatch:
            pairs = long(b"".join(x for _, x in asked), known, part)
            level = np.zeros(len(pairs), dtype=np.uint8)
            if place:
                rows = np.full(m.segments // groups, -1)
                rows[[x // groups for x in place]] = list(place.values())
                rows = rows[m.segment(pairs) // groups]
                level[rows >= 0] = probe(np.stack(bodies), rows[rows >= 0], pairs[rows >= 0])
            ends = np.cumsum([len(x) // each for _, x in asked]).tolist()
            cut = [level[a:b].tobytes() for a, b in zip([0, *ends], ends, strict=False)]
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in asked], pa.int64()), pa.array([part] * len(asked), pa.int32()), pa.array(cut, pa.binary())], names=["batch", "part", "body"])

        for batch in batches:
            for at, g, segment, body in zip(*(batch.column(c).to_pylist() for c in ("batch", "part", "segment", "body")), strict=True):
                if g != part:
                    if asked:
                        yield done()
                    part, bodies, place, asked = g, [], {}, []
                if segment is None:
                    asked.append((at, body))
                    continue
                row = np.frombuffer(body, dtype=np.uint8)  # the group's segments come first
                if segment in place:
                    bodies[place[segment]] = bodies[place[segment]] | row
                else:
                    place[segment] = len(bodies)
                    bodies.append(row)
            if asked:
                yield done()
                asked = []

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = shared.value
        for batch in batches:
            for k, at in enumerate(batch.column("batch").to_pylist()):
                texts, ids, out, answers = (batch.column(c).slice(k, 1).flatten() for c in ("texts", "ids", "held", "answers"))
                stream, sizes = token_stream(texts)
                asked = np.unique(pair_hashes(stream, sizes)[1])
                levels, here = np.zeros(len(asked), dtype=np.int64), m.held(asked)
                levels[here] = m.level(asked[here])
                there = np.flatnonzero(~here)
                bodies = sorted(zip(answers.field("part").to_pylist(), answers.field("body").to_pylist(), strict=True))
                levels[there[split(m, asked[there])[0]]] = np.frombuffer(b"".join(x for _, x in bodies), dtype=np.uint8)
                yield scored(m, np.arange(at, at + len(sizes)), ids, out, stream, sizes, asked, levels)

    batches = gathered(docs)
    buckets = batches.scratch_buckets[1]
    texts = stored(batches, "batches")
    bodies = filter_rows.filter(F.col("segment") >= len(model.filter)).select(F.lit(-1).cast("long").alias("batch"), F.col("segment").bitwiseAND(F.lit(groups - 1)).alias("part"), "segment", "body")
    met = bodies.unionByName(texts.select("batch", "texts").transform(in_batches, send, SENT))
    levels = stored(met.repartition("part").sortWithinPartitions("part", "batch", "segment").transform(in_batches, answer, "batch long, part int, body binary"), "levels")
    discard(filter_rows)
    answers = levels.repartition(buckets, "batch").groupBy("batch").agg(F.collect_list(F.struct("part", "body")).alias("answers"))
    whole = texts.join(answers.hint("shuffle_hash"), "batch", "left").select("batch", "texts", "ids", "held", F.coalesce("answers", F.array().cast("array<struct<part:int,body:binary>>")).alias("answers"))
    out = stored(whole.transform(in_batches, finish, SCORED), "scored")
    discard(texts, levels)
    return out


def with_gains(rows: DataFrame, params: Params, total: float) -> DataFrame:
    """rows with ``gain``: what the pairs in ``far`` add to the score, by the counts in ``seen``, the row's tokens that are not held. A token
    without a count has no pair. Both lists belong to one text, so nothing is joined or exploded for its pairs."""
    plain = [f for f in rows.schema.fields if f.name not in ("far", "seen")]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in plain), "gain double"])

    def cells(column: pa.ListArray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """The rows that own a list's values, and the values' fields."""
        owner = np.repeat(np.arange(len(column)), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(column), 0)))
        values = column.flatten()
        return owner, {f.name: values.field(i).to_numpy(zero_copy_only=False) for i, f in enumerate(values.type)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, far = cells(batch.column("far"))
            whose, seen = cells(batch.column("seen"))
            key = lambda who, h: mix(mix(who.astype(np.uint64) + GOLD) ^ h.astype(np.int64).view(np.uint64))
            names = key(whose, seen["h"]) if len(whose) else np.empty(0, np.uint64)
            order = np.argsort(names)
            names, counts = names[order], np.asarray(seen["c"], dtype=np.int64)[order] if len(whose) else np.empty(0, np.int64)

            def count(held: np.ndarray, h: np.ndarray) -> np.ndarray:
                if not len(names):
                    return np.maximum(held, 0)
                asked = key(owner, h)
                at = np.minimum(np.searchsorted(names, asked), len(names) - 1)
                return np.where(held >= 0, held, np.where(names[at] == asked, counts[at], 0))

            gain = np.zeros(batch.num_rows)
            if len(owner):
                cv, cw = count(far["cv"], far["v"]), count(far["cw"], far["w"])
                ratio = params.weight * np.minimum(1.0, level_count(far["q"], params.least) / np.maximum(1, cv)) / ((1 - params.weight) * (cw + 1) / total)
                gain = np.bincount(owner, np.where((cv > 0) & (cw > 0), np.log10(1 + ratio), 0.0), batch.num_rows)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in plain), pa.array(gain)], names=[*(f.name for f in plain), "gain"])

    return rows.transform(in_batches, run, schema)


def score(docs: DataFrame, held_out: Column, params: Params | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. Learns from the rows that are not held out."""
    params = params or Params()
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"))
    model, counts, filter_rows = learn(read.filter(~F.col("held_out")), params)
    if model.whole():
        discard(filter_rows)
        rows = stored(score_here(read, model), "scored")
    else:
        rows = score_there(read, model, filter_rows)
    asked = rows.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("uid", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    total = float(model.tokens + model.types + 1)
    found = asked.join(counts, "h", "left").select("uid", "h", "times", F.coalesce("c", F.lit(0)).cast("long").alias("c"))
    base = F.col("times") * F.log10((F.col("c") + 1) / F.lit(total))
    seen = F.collect_list(F.when(F.col("c") > 0, F.struct("h", "c")))
    rest = found.groupBy("uid").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"), F.sum(base).alias("more"), F.sum("times").alias("others"), seen.alias("seen"))
    both = with_gains(rows.drop("rare", "times").join(rest, "uid", "left"), params, total)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    shift = F.lit(float(np.log10(1 - params.weight)))
    return both.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(int(model.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more")).alias("base_score"),
        (F.col("score") + zero("more") + F.col("gain") + F.coalesce("others", F.lit(0)) * shift).alias("score"),
    )
