"""Language identification with hyperdimensional profiles.

Every letter, whatever its script, has a random bipolar vector of ``dims`` entries, made from its (lower-case) code point;
anything that is no letter shares one. A 3-gram abc is bound as ``roll(A, 2) * roll(B, 1) * C``; the n-grams of a text
are bundled by their sum, and a text is compared with the bundle of each language's learning texts by cosine.

The bundle of a language is linear in its n-gram counts, so learning sums weighted counts (every text weighs the same) of
each batch before it binds them, and adds up bundles map-side first; the profiles are languages x dims numbers, for at
most ``MAX_LANGUAGES`` languages. Prototypes are compared after the mean profile is taken from both sides, which removes
what all languages share. That best cosine is never below 0, so it can't tell that no language fits; ``fit`` can: the
uncentred cosine over the one expected of a text of as many 3-grams drawn from the profile, sqrt(n s / (n s + 1)) with s
the profile's own collision rate. It is about 1 in a learned language, whatever the length, and near 0 for random letters.

Defined results: a null text, or one without a letter, is ``und`` with score 0; with no learning rows every text is
``und``; ties go to the language that sorts first; rows with an equal doc_id are separate; other columns are not
read; an empty table gives no rows; learning from more than MAX_LANGUAGES values of lang is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import GOLD, by_bytes, in_batches, mix

UND = "und"
MAX_LANGUAGES = 2000
#: Cells of the matrix (texts x distinct 3-grams) that are bundled at once, and 3-grams that are bound at once.
CELLS, BOUND = 1 << 22, 2048


@cache
def lower_letters() -> np.ndarray:
    """For each code point of the Basic Multilingual Plane its lower-case letter; 0 for what is no letter."""
    return np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x10000)], dtype=np.uint32)


def letter_codes(codes: np.ndarray) -> np.ndarray:
    out = lower_letters()[np.minimum(codes, 0xFFFF)]
    if (far := np.flatnonzero(codes >= 0x10000)).size:
        values, at = np.unique(codes[far], return_inverse=True)
        out[far] = np.array([ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in values.tolist()], dtype=np.uint32)[at]
    return out


def letter_vectors(letters: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """A row of -1 and 1 for each letter."""
    with np.errstate(over="ignore"):
        start = mix(letters.astype(np.uint64) * GOLD + np.uint64(seed))
        words = mix(start[:, None] + np.arange(1, -(-dims // 64) + 1, dtype=np.uint64)[None, :] * GOLD)
    bits = np.unpackbits(words.view(np.uint8), axis=1)[:, :dims]
    return (2 * bits.astype(np.int8) - 1).astype(np.int8)


def gram_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows (texts, in order), 3-grams (three letters each) and their counts, and whether each text has a letter. Runs of non-letters count as one."""
    joined = "".join(f"\n{t}\n" for t in texts)
    letters = letter_codes(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32))
    owner = np.repeat(np.arange(len(texts)), [len(t) + 2 for t in texts])
    letter = letters > 0
    keep = letter | np.concatenate([[True], letter[:-1] | (owner[1:] > owner[:-1])])[: len(letter)]
    letters, owner, letter = letters[keep], owner[keep], letter[keep]
    has = np.bincount(owner[letter], minlength=len(texts)) > 0
    if len(letters) < 3:
        return np.empty(0, np.int64), np.empty((0, 3), np.uint32), np.empty(0, np.int64), has
    alphabet, place = compact(letters)
    inside = np.flatnonzero((owner[:-2] == owner[2:]) & (letters[1:-1] > 0))
    size = np.uint64(len(alphabet))
    grams = (place[inside] * size + place[inside + 1]) * size + place[inside + 2]  # below 2^61: there are 1.1 million code points
    span = int(size) ** 3
    if span * len(texts) < 1 << 62:
        keys, counts = np.unique(owner[inside].astype(np.uint64) * np.uint64(span) + grams, return_counts=True)
        rows, found = (keys // np.uint64(span)).astype(np.int64), keys % np.uint64(span)
    else:
        distinct, gram = np.unique(grams, return_inverse=True)
        keys, counts = np.unique(owner[inside] * len(distinct) + gram, return_counts=True)
        rows, found = keys // max(1, len(distinct)), distinct[keys % max(1, len(distinct))]
    three = np.stack([alphabet[(found // (size * size)).astype(np.int64)], alphabet[(found // size % size).astype(np.int64)], alphabet[(found % size).astype(np.int64)]], axis=1)
    return rows, three, counts, has


def compact(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct letters, sorted, and the place of each letter among them."""
    if letters.max() >= 0x10000:
        alphabet, place = np.unique(letters, return_inverse=True)
        return alphabet, place.astype(np.uint64)
    seen = np.zeros(0x10000, dtype=bool)
    seen[letters] = True
    return np.flatnonzero(seen).astype(np.uint32), (np.cumsum(seen) - 1).astype(np.uint64)[letters]


def bound(grams: np.ndarray, dims: int, seed: int) -> np.ndarray:
    """The bound vectors of 3-grams."""
    letters, at = np.unique(grams, return_inverse=True)
    at, table = at.reshape(grams.shape), letter_vectors(letters, dims, seed)
    return np.roll(table, 2, axis=1)[at[:, 0]] * np.roll(table, 1, axis=1)[at[:, 1]] * table[at[:, 2]]


def numbers(grams: np.ndarray) -> np.ndarray:
    return grams[:, 0].astype(np.uint64) << np.uint64(42) | grams[:, 1].astype(np.uint64) << np.uint64(21) | grams[:, 2].astype(np.uint64)


def bundles(rows: np.ndarray, grams: np.ndarray, counts: np.ndarray, texts: int, dims: int, seed: int) -> np.ndarray:
    """A bundle for each text. Texts are halved until texts x distinct 3-grams is small, so memory is bounded."""
    out, open_ = np.zeros((texts, dims), dtype=np.float32), [(0, texts)]
    code = numbers(grams)
    while open_:
        low, high = open_.pop()
        i, j = np.searchsorted(rows, [low, high])
        distinct, first, place = np.unique(code[i:j], return_index=True, return_inverse=True)
        if (high - low) * len(distinct) > CELLS and high - low > 1:
            middle = (low + high) // 2
            open_ += [(low, middle), (middle, high)]
            continue
        dense = np.zeros((high - low, len(distinct)), dtype=np.float32)
        dense[rows[i:j] - low, place] = counts[i:j]
        for k in range(0, len(distinct), BOUND):
            out[low:high] += dense[:, k : k + BOUND] @ bound(grams[i:j][first[k : k + BOUND]], dims, seed).astype(np.float32)
    return out


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return by_bytes(batches, per_row=512)


def learn(docs: DataFrame, learning: Column, dims: int, seed: int) -> tuple[list[str], np.ndarray]:
    """Languages in order, and their bundles (rows), each the mean over all learning documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        texts: dict[str, int] = {}
        for batch in small(batches):
            names, lang = np.unique(np.array(batch.column("lang").to_pylist(), dtype=object), return_inverse=True)
            rows, grams, counts, has = gram_counts([t or "" for t in batch.column("text").to_pylist()])
            weight = counts / np.maximum(1, np.bincount(rows, counts, minlength=len(lang)))[rows]
            distinct, first, place = np.unique(numbers(grams), return_index=True, return_inverse=True)
            for x in names.tolist():
                sums.setdefault(x, np.zeros(dims))
            if len(sums) > MAX_LANGUAGES:
                raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
            for k in range(0, len(distinct), BOUND):
                vectors = bound(grams[first[k : k + BOUND]], dims, seed).astype(np.float32)
                own = (place >= k) & (place < k + BOUND)
                for n, x in enumerate(names.tolist()):
                    mine = own & (lang[rows] == n)
                    sums[x] += np.bincount(place[mine] - k, weight[mine], len(vectors)).astype(np.float32) @ vectors
            for n, x in enumerate(names.tolist()):
                texts[x] = texts.get(x, 0) + int(np.sum(has & (lang == n)))
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([texts[x] for x in sums], pa.int64()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], names=["lang", "n", "vector"])

    used = docs.filter(learning & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    parts = used.transform(in_batches, run, "lang string, n long, vector array<double>")
    summed = parts.select("lang", "n", F.posexplode("vector").alias("i", "v")).groupBy("lang", "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    profiles = summed.groupBy("lang").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("i", "v"))).alias("vector")).filter("n > 0")
    got = sorted((r["lang"], [x["v"] / r["n"] for x in r["vector"]]) for r in profiles.limit(MAX_LANGUAGES + 1).collect())  # a row for each language
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"lang has more than {MAX_LANGUAGES} values")
    return [g[0] for g in got], np.array([g[1] for g in got]).reshape(len(got), dims)


def unit(m: np.ndarray) -> np.ndarray:
    return m / np.maximum(1e-12, np.linalg.norm(m, axis=-1, keepdims=True))


def predict(docs: DataFrame, languages: list[str], bundles_: np.ndarray, dims: int, seed: int, extra: list[str], fit: bool = False) -> DataFrame:
    """``extra`` columns of docs, lang_pred, score, and with ``fit`` the best fit of any language."""
    profiles = unit(bundles_)
    centre = profiles.mean(axis=0) if len(languages) > 1 else np.zeros(dims)
    centred = unit(profiles - centre).astype(np.float32)
    collisions = np.square(bundles_).sum(axis=1) / dims
    shared = docs.sparkSession.sparkContext.broadcast((languages, centre.astype(np.float32), centred, profiles.astype(np.float32), collisions))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in extra), "lang_pred string", "score double", *(["fit double"] if fit else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, middle, targets, plain, rates = shared.value
        for batch in small(batches):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            rows, grams, counts, has = gram_counts(texts)
            best, score, fits = np.zeros(len(texts), dtype=int), np.zeros(len(texts)), np.zeros(len(texts))
            if len(rows) and names:
                bundle = unit(bundles(rows, grams, counts, len(texts), dims, seed))
                expected = np.bincount(rows, counts, len(texts))[:, None] * rates
                fits = (bundle @ plain.T / np.sqrt(np.maximum(1e-12, expected / (expected + 1)))).max(axis=1)
                cosine = unit(bundle - middle) @ targets.T
                best = cosine.argmax(axis=1)
                score = np.clip((1 + cosine[np.arange(len(texts)), best]) / 2, 0, 1)
            known = has & bool(names)
            said = [names[b] if ok else UND for b, ok in zip(best.tolist(), known.tolist(), strict=True)]
            columns = [batch.column(c) for c in extra]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(said, pa.string()), *(pa.array(np.where(known, x, 0.0), pa.float64()) for x in (score, fits)[: 1 + fit])], names=[*extra, "lang_pred", "score", *["fit"][:fit]])

    read = docs.select(*dict.fromkeys([*extra, "text"]))
    return read.transform(in_batches, run, schema)


def identify(docs: DataFrame, learning: Column, extra: list[str], dims: int = 1024, seed: int = 11, fit: bool = False) -> DataFrame:
    """Learn from the rows that ``learning`` selects (with a language), then predict every row."""
    languages, found = learn(docs, learning, dims, seed)
    return predict(docs, languages, found, dims, seed, extra, fit)
