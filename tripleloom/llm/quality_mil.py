"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of ``passage`` words. Every passage is counted over hashed words, hashed pairs of
neighbouring words, hashed word endings and shape measures, and encoded by a learned layer, h = tanh(x E + e). Gated attention weighs the
passages, a = softmax(w . (tanh(V h) * sigmoid(U h))), and the document's score is sigmoid(c . sum(a h) + d). All
weights are learned together from document labels by Adam, on the driver, from a bounded sample: at most ``sample`` labelled
documents of each class (those with the smallest id hash) among those of at most ``sample_words`` words, with all of their passages.
When scoring, every passage of every document is encoded.

Defined results: a null or empty text is one passage without words; without labels every score is 0.5; equal ids
and repeated rows are scored row by row; of a labelled id with several texts the smallest is learned from; a null doc_id is never held
out and never learned from; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, by_bytes, in_batches, mix, text_bytes, word_edges, word_hashes

WORDS, PAIRS, ENDINGS, SHAPES = 512, 512, 256, 8
WIDTH = WORDS + PAIRS + ENDINGS + SHAPES
HIDDEN, GATE = 32, 16

_LETTER = np.array([chr(b).isalpha() and b < 128 or b >= 128 for b in range(256)])
_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_DIGIT = np.array([48 <= b <= 57 for b in range(256)])


def passages(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of every passage (rows of WIDTH, each row of shares), and the number of passages of each text."""
    data, offsets = text_bytes(texts)
    start, end, words = word_edges(data, offsets)
    word, _ = word_hashes(texts)
    text_of = np.repeat(np.arange(len(words)), words)
    count = np.maximum(1, -(-words // size))
    first_word = np.cumsum(words) - words
    passage = (np.cumsum(count) - count)[text_of] + (np.arange(len(start)) - first_word[text_of]) // size
    total = int(count.sum())
    out = np.zeros((total, WIDTH), dtype=np.float32)
    if len(start):
        last = data[end - 1].astype(np.uint64) | np.where(end - start > 1, data[end - 2], 0).astype(np.uint64) << np.uint64(8)
        bucket = lambda h, n: (mix(h + GOLD) % np.uint64(n)).astype(np.int64)
        with np.errstate(over="ignore"):
            pair = bucket(word[:-1] * GOLD + word[1:], PAIRS)
        together = passage[:-1] == passage[1:]
        n = np.bincount(passage, minlength=total)
        cells = [passage * WIDTH + bucket(word, WORDS), passage[:-1][together] * WIDTH + WORDS + pair[together], passage * WIDTH + WORDS + PAIRS + bucket(last, ENDINGS)]
        out[:] = np.bincount(np.concatenate(cells), minlength=total * WIDTH).reshape(total, WIDTH)
        sums = lambda flag: np.concatenate([[0], np.cumsum(flag[data], dtype=np.int32)])
        length = (end - start).astype(np.float64)
        of = lambda c: np.bincount(passage, c[end] - c[start], total)
        letters, upper, digits = (of(sums(f)) for f in (_LETTER, _UPPER, _DIGIT))
        chars = np.maximum(1.0, np.bincount(passage, length, total))
        same = np.bincount(passage[:-1], (word[:-1] == word[1:]) & together, total)
        shapes = [letters / chars, upper / chars, digits / chars, 1 - (letters + digits) / chars, chars / np.maximum(1, n) / 10, same / np.maximum(1, n), np.minimum(1, n / size), np.bincount(passage, length == 1, total) / np.maximum(1, n)]
        out[:, : WIDTH - SHAPES] /= np.maximum(1, n)[:, None] / 4
        out[:, WIDTH - SHAPES :] = np.stack(shapes, axis=1) * (n > 0)[:, None]
    return out, count


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    return {"E": small(WIDTH, HIDDEN) * 3, "e": np.zeros(HIDDEN, np.float32), "V": small(HIDDEN, GATE), "U": small(HIDDEN, GATE), "w": small(GATE), "c": small(HIDDEN), "d": np.zeros(1, np.float32)}


def forward(p: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
    """Scores of bags whose passages lie one after the other."""
    first = np.cumsum(count) - count
    bag = np.repeat(np.arange(len(count)), count)
    h = np.tanh(x @ p["E"] + p["e"])
    gate, lock = np.tanh(h @ p["V"]), sigmoid(h @ p["U"])
    s = (gate * lock) @ p["w"]
    s = np.exp(s - np.maximum.reduceat(s, first)[bag])
    a = s / np.add.reduceat(s, first)[bag]
    z = np.add.reduceat(a[:, None] * h, first, axis=0)
    return {"h": h, "gate": gate, "lock": lock, "a": a, "z": z, "bag": bag, "first": first, "score": sigmoid(z @ p["c"] + p["d"])}


def gradients(p: dict[str, np.ndarray], x: np.ndarray, count: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted mean log loss."""
    f = forward(p, x, count)
    h, gate, lock, a, bag = (f[k] for k in ("h", "gate", "lock", "a", "bag"))
    dlogit = (f["score"] - y) * weight / weight.sum()
    dz = dlogit[:, None] * p["c"]
    da = np.einsum("ij,ij->i", h, dz[bag])
    ds = a * (da - np.add.reduceat(a * da, f["first"])[bag])
    dmix = ds[:, None] * p["w"]
    dgate, dlock = dmix * lock * (1 - gate**2), dmix * gate * lock * (1 - lock)
    dh = a[:, None] * dz[bag] + dgate @ p["V"].T + dlock @ p["U"].T
    dpre = dh * (1 - h**2)
    return {"E": x.T @ dpre, "e": dpre.sum(axis=0), "V": h.T @ dgate, "U": h.T @ dlock, "w": (gate * lock).T @ ds, "c": f["z"].T @ dlogit, "d": dlogit.sum(keepdims=True)}


def fit(x: np.ndarray, count: np.ndarray, y: np.ndarray, seed: int = 4, epochs: int = 14, batch: int = 64, rate: float = 0.004) -> dict[str, np.ndarray]:
    """Adam over mini-batches of bags; both classes weigh the same."""
    p, rng = initial(seed), np.random.default_rng(seed)
    if len(y) == 0:
        return p | {"c": np.zeros(HIDDEN, np.float32)}
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    weight = share * len(y)
    first = np.cumsum(count) - count
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(u) for k, u in p.items()}
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for i in range(0, len(y), batch):
            bags = order[i : i + batch]
            rows = np.concatenate([np.arange(first[b], first[b] + count[b]) for b in bags])
            g, t = gradients(p, x[rows], count[bags], y[bags], weight[bags]), t + 1
            for k in p:
                gk = g[k] + 1e-5 * p[k]
                m[k] = 0.9 * m[k] + 0.1 * gk
                v[k] = 0.999 * v[k] + 0.001 * gk**2
                p[k] = (p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return p


def sample(docs: DataFrame, labels: DataFrame, learning: Column, size: int, seed: int, most: int, most_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, passages of each document, and labels of the learning sample: at most 2 x ``most`` texts of ``most_words`` words."""
    ask = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).filter(learning).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y"))
    ask = ask.groupBy("doc_id").agg(F.min("y").alias("y"))
    # more ids than are needed, as some have no text or too long a one
    each = [ask.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(2 * most) for k in (0, 1)]
    chosen = F.broadcast(each[0].unionByName(each[1]))  # at most 4 x ``most`` rows
    texts = docs.join(chosen, "doc_id").select("doc_id", "y", "text")
    short = F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)) <= most_words
    texts = texts.filter(short).groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = [texts.filter(F.col("y") == k).orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most) for k in (0, 1)]
    got = sorted(rows[0].unionByName(rows[1]).collect(), key=lambda r: r["doc_id"])
    x, count = passages(pa.array([r["text"] for r in got], pa.string()), size)
    return x, count, np.array([r["y"] for r in got], dtype=np.int64)


def score(docs: DataFrame, labels: DataFrame, held_out: Column, size: int = 64, threshold: float = 0.3, seed: int = 4, sample_docs: int = 1200, sample_words: int = 4096) -> DataFrame:
    """doc_id, held_out, score, predicted, passages, attention (the largest weight). Learns from labels that are not held out."""
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out.alias("held_out"))
    weights = fit(*sample(read, labels, ~held_out, size, seed, sample_docs, sample_words), seed=seed)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, limit=1 << 19, per_row=512):
            x, count = passages(batch.column("text"), size)
            f = forward(shared.value, x, count)
            score = f["score"].astype(np.float64)
            most = np.maximum.reduceat(f["a"], f["first"]).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(count), pa.array(most)], names=["doc_id", "held_out", "score", "predicted", "passages", "attention"])

    return read.transform(in_batches, run, "doc_id long, held_out boolean, score double, predicted int, passages long, attention double")
