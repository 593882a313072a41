"""Quality by multiple-instance learning, and language-model scores, against plain Python."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripleloom.llm import lm, quality_mil
from tripleloom.llm.common import bucket_of


def crc(i, n):
    return zlib.crc32(str(i).encode()) % n


# ---- quality ----


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(y))
    rank[order] = np.arange(1, len(y) + 1)
    p = y == 1
    return (rank[p].sum() - p.sum() * (p.sum() + 1) / 2) / (p.sum() * (~p).sum())


def test_held_out_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = quality_mil.score(docs, labels, bucket_of("doc_id", 5) == 0).collect()
    y = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [r for r in got if r["held_out"] and r["doc_id"] in y]
    assert len(got) == 1000 and all(r["held_out"] == (crc(r["doc_id"], 5) == 0) for r in got)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = np.array([y[r["doc_id"]] for r in held])
    assert auc(np.array([r["score"] for r in held]), truth) > 0.95
    assert np.mean([r["predicted"] for r in held] == truth) > 0.93


def test_quality_edges(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 0, 1), (7, 1, 0), (9, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality_mil.score(odd, labels, bucket_of("doc_id", 5) == 0).collect()
    assert len(got) == odd.count() and all(0 <= r["score"] <= 1 for r in got)
    same = [r["score"] for r in got if r["doc_id"] in (9, 10)]
    assert same[0] == pytest.approx(same[1], abs=1e-6)
    none = quality_mil.score(odd, labels.filter(F.lit(False)), F.lit(False)).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_mil.score(empty, labels, F.lit(False)).collect() == []


def test_passages():
    x, count = quality_mil.passages(pa.array(["a b c d e", "", "  x\ty ", None]), 2)
    assert count.tolist() == [3, 1, 1, 1] and x.shape == (6, quality_mil.WIDTH)
    alone, _ = quality_mil.passages(pa.array(["c d"]), 2)
    assert np.allclose(x[1], alone[0])
    assert not x[3].any() and not x[5].any()


def test_scores_equal_a_plain_loop(spark, small):
    """All documents, passage by passage: encoding, gates, softmax and the weighted sum."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    held = bucket_of("doc_id", 5) == 0
    got = {r["doc_id"]: r for r in quality_mil.score(small, labels, held, size=16).collect()}
    read = small.select("doc_id", "text")
    p = {k: v.astype(float) for k, v in quality_mil.fit(*quality_mil.sample(read, labels, ~held, 16, 4, 1200, 4096), seed=4).items()}
    logistic = lambda v: 1 / (1 + np.exp(-v))
    for r in read.collect():
        words = (r["text"] or "").encode().split()
        logits, bag = [], []
        for k in range(0, max(1, len(words)), 16):
            x = quality_mil.passages(pa.array([b" ".join(words[k : k + 16]).decode()]), 16)[0][0].astype(float)
            h = np.array([np.tanh(x @ p["E"][:, j] + p["e"][j]) for j in range(quality_mil.HIDDEN)])
            bag.append(h)
            logits.append(sum(p["w"][j] * np.tanh(h @ p["V"][:, j]) * logistic(h @ p["U"][:, j]) for j in range(quality_mil.GATE)))
        a = np.exp(np.array(logits) - max(logits))
        a /= a.sum()
        want = logistic(sum(w * (h @ p["c"]) for w, h in zip(a, bag, strict=True)) + p["d"][0])
        assert got[r["doc_id"]]["score"] == pytest.approx(want, abs=1e-4) and got[r["doc_id"]]["attention"] == pytest.approx(a.max(), abs=1e-4)
        assert got[r["doc_id"]]["passages"] == len(bag)


def test_a_repeated_id_is_learned_from_once(spark):
    rows = [(1, f"text {i} of the id") for i in range(300)] + [(2, "other words"), (3, None), (4, "w " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (4, 1), (9, 1)], "doc_id long, quality int")
    x, count, y = quality_mil.sample(docs, labels, F.lit(True), 64, 4, 10, 4096)
    assert y.tolist() == [0, 0, 1] and count.tolist() == [1, 1, 1]
    assert quality_mil.sample(docs, labels, F.lit(True), 64, 4, 10, 9999)[1].tolist() == [1, 1, 1, 79]  # every passage


def test_gradients():
    rng = np.random.default_rng(0)
    x, count, y = rng.random((9, quality_mil.WIDTH)).astype(np.float32), np.array([1, 3, 5]), np.array([1, 0, 1])
    p = {k: v.astype(np.float64) for k, v in quality_mil.initial(1).items()}
    p["E"] /= 20
    w = np.array([1.0, 2.0, 1.0])
    loss = lambda q: -np.sum(w * np.log(np.where(y == 1, s := quality_mil.forward(q, x.astype(float), count)["score"], 1 - s))) / w.sum()
    g = quality_mil.gradients(p, x.astype(float), count, y, w)
    for k, v in p.items():
        i = tuple(int(rng.integers(0, n)) for n in v.shape)
        up, down = {**p, k: v.copy()}, {**p, k: v.copy()}
        up[k][i] += 1e-5
        down[k][i] -= 1e-5
        assert g[k][i] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=1e-3, abs=1e-8), k


# ---- language model ----


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\0end"]


def plain_scores(rows, held, weight, head_from):
    """Exact base scores, and model scores with exact pair counts by level (no filter)."""
    uni, pairs, texts = collections.Counter(), collections.Counter(), 0
    for i, t in rows:
        if not held(i):
            ts = tokens(t)
            uni.update(ts)
            pairs.update(zip([b"\0begin", *ts], ts, strict=False))
            texts += 1
    n, v = sum(uni.values()), len(uni)
    out = []
    for i, t in rows:
        ts, base, score = tokens(t), 0.0, 0.0
        for a, b in zip([b"\0begin", *ts], ts, strict=False):
            p = (uni[b] + 1) / (n + v + 1)
            base += math.log10(p)
            p *= 1 - weight
            before = texts if a == b"\0begin" else uni[a]
            if uni[b] >= head_from and before >= head_from and pairs[a, b] >= 2:
                q = 1 + int(math.log2(pairs[a, b] - 1))
                p += weight * min(1, math.sqrt((2 ** (q - 1) + 1) * 2**q) / before)
            score += math.log10(p)
        out.append((str(i), len(ts), sum(uni[x] > 0 for x in ts), n, base, score))
    return sorted(out)


def check(docs, params, head_from, loose=0.0):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score(docs, bucket_of("doc_id", 7) == 2, params).collect())
    want = plain_scores(rows, lambda i: i is not None and crc(i, 7) == 2, params.weight, head_from)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[4] == pytest.approx(w[4], rel=1e-9)
        assert g[5] == pytest.approx(w[5], rel=loose or 1e-9, abs=1e-6)
    return got


def test_scores_equal_plain_python(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check(docs, lm.Params(bits=60), 1)  # a filter so large that no false hit is likely
    got = check(docs, lm.Params(), 1, loose=0.05)
    assert sum(g[5] for g in got) > sum(g[4] for g in got)


def test_pairs_with_rare_tokens_count(small):
    """With few counts held, pairs with any other token still have their level."""
    for held in (0, 300):
        check(small, lm.Params(held=held, bits=60), 1)


def test_no_entry_is_missed(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, _, _ = lm.learn(docs, lm.Params())
    stream, sizes = lm.token_stream(pa.array([r["text"] for r in docs.select("text").collect()]))
    pairs, counts = np.unique(lm.pair_hashes(stream, sizes)[1], return_counts=True)
    want = np.where(counts > 1, 1 + np.log2(np.maximum(1, counts - 1)).astype(int), 0)
    got = model.level(pairs)
    assert (got >= want).all() and np.mean(got > want) < 0.01


def test_a_filter_too_large_to_broadcast_gives_the_same(spark, small, odd, monkeypatch):
    """More, smaller segments, which pairs travel to: row by row the scores of the broadcast filter."""
    for entries, groups in ((1 << 20, 4096), (10, 16)):
        monkeypatch.setattr(lm, "SEGMENT_ENTRIES", entries)
        monkeypatch.setattr(lm, "GROUPS", groups)
        for docs in (small, odd):
            plain_row = lambda r: str([round(x, 8) if isinstance(x, float) else x for x in r])
            here, there = (sorted(map(plain_row, lm.score(docs, bucket_of("doc_id", 7) == 2, lm.Params(broadcast_bytes=n)).collect())) for n in (1 << 30, 0))
            assert here == there
    assert lm.learn(small, lm.Params(broadcast_bytes=0))[0].segments > lm.SEGMENTS


def test_model_edges(spark, odd, empty):
    check(odd, lm.Params(bits=60), 1)
    assert lm.score(empty, F.lit(False)).collect() == []
    none = lm.score(odd, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], r["base_score"]) for r in none} == {(0, 0, 0.0)}


def test_pairs_seen_once_have_a_level(spark):
    """What op3_lm runs: no pair is left out, and a pair seen c times has the level 1 + floor(log2(c))."""
    texts = ["a b", "a c", "a c", "b b b b b b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model, _, _ = lm.learn(docs, lm.Params.whole(bits=60))
    pairs, counts = np.unique(lm.pair_hashes(*lm.token_stream(pa.array(texts)))[1], return_counts=True)
    assert (counts == 1).any() and model.level(pairs).tolist() == (1 + np.floor(np.log2(counts))).tolist()
    assert lm.level_count(np.arange(1, 4), 1) == pytest.approx([1, 6**0.5, 28**0.5])
    words = {"a": 3, "b": 7, "c": 2, "end": 4}
    n, types = sum(words.values()), len(words)
    both = {("begin", "a"): 6**0.5, ("a", "b"): 1.0, ("b", "end"): 6**0.5}  # seen 3, 1 and 2 times
    before = {"begin": 4, **words}
    want = sum(math.log10(0.9 * (words[b] + 1) / (n + types + 1) + 0.1 * min(1, c / before[a])) for (a, b), c in both.items())
    for broadcast in (1 << 30, 0):
        got = lm.score(docs, F.lit(False), lm.Params.whole(bits=60, broadcast_bytes=broadcast)).filter("doc_id = 0").first()
        assert got["score"] == pytest.approx(want, rel=1e-9)


def test_pairs_travel_short(spark, small, monkeypatch):
    """What is written while pairs travel to the filter is about the texts and 5 bytes a pair: no stream of 8 bytes a token is kept."""
    pairs = np.arange(1, 4000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - lm.PAIR_BITS)
    for known in (2, 8, 12):
        own = pairs[pairs & np.uint64((1 << known) - 1) == 3]
        body = lm.short(own, known)
        assert len(body) == len(own) * (6 if known == 2 else 5) and (lm.long(body, known, 3) == own).all()
    made, stored = {}, lm.stored

    def kept(df, name):
        made[name] = stored(df, name)
        if name == "batches":
            made["texts"] = made[name].select(F.explode("texts").alias("text"))
            assert made["texts"].count() == small.count() and made[name].schema.simpleString() == "struct<batch:bigint,texts:array<string>,ids:array<bigint>,held:array<boolean>>"
        return made[name]

    monkeypatch.setattr(lm, "stored", kept)
    assert lm.score(small, F.lit(False), lm.Params.whole(broadcast_bytes=0)).count() == small.count()
    assert "batches" in made and "asked" not in made


def test_a_part_of_the_filter_is_broadcast(spark, small, monkeypatch):
    """As many segments as fit are probed where the texts are: fewer pairs travel, texts do not, and scores are the same."""
    assert [lm.bucket_numbers(np.array([x]), 7)[0] for x in (0, 5, -3, 3 << 40)] == [spark.sql(f"SELECT pmod(hash({x}L), 7)").first()[0] for x in (0, 5, -3, 3 << 40)]
    plain_row = lambda r: str([round(x, 8) if isinstance(x, float) else x for x in r])
    model, _, rows = lm.learn(small, lm.Params.whole())
    half, size, stored = 100 * model.filter.shape[1], {}, lm.stored

    def kept(df, name):
        if name == "scored":
            size[most] = size.get(most, 0), df._jdf.queryExecution().executedPlan().toString()
        out = stored(df, name)
        if name == "levels":
            size[most] = out.agg(F.sum(F.length("body"))).first()[0]
        return out

    monkeypatch.setattr(lm, "stored", kept)
    got = {}
    for most in (1 << 30, half, 0):
        got[most] = sorted(map(plain_row, lm.score(small, bucket_of("doc_id", 7) == 2, lm.Params.whole(broadcast_bytes=most)).collect()))
    assert got[1 << 30] == got[half] == got[0]
    assert 0 < size[half][0] < 0.8 * size[0][0]
    assert size[half][1].count("Exchange") == 1  # that of the levels
