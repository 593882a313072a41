"""The pipeline against plain Python, stage by stage."""

import collections
import hashlib
import random

from pyspark.sql import functions as F
from test_jaccard import brute
from test_token_operators import plain

import corpus_pipeline
from tripleloom.llm import langid, secrets_scan
from tripleloom.llm.common import stored


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows = docs.collect()
        after = {r["doc_id"]: r for r in rows}
        assert len(after) == len(rows)
        if name == "language_id":
            assert after.items() <= before.items() and len(after) >= 0.98 * len(before)
        elif name == "near_duplicates":
            comps, _ = brute([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert after == {i: r for i, r in before.items() if comps[i] == i} and len(after) < len(before)
        elif name == "secrets":
            assert set(after) == set(before)
            secret = collections.defaultdict(list)
            for r in secrets_scan.scan(spark.createDataFrame(list(before.values()))).filter("is_secret").collect():
                secret[r["doc_id"]].append(r["candidate"])
            for i, r in before.items():
                assert (after[i]["text"] == r["text"]) == (i not in secret)
                assert not any(s in after[i]["text"] for s in secret[i])
        else:
            assert after.items() <= before.items()
            words = lambda rs: sum(len(r["text"].encode().split()) for r in rs)
            got, most = words(after.values()), corpus_pipeline.MIX.percent * words(before.values()) // 100
            assert 0.5 * most < got
            leaves = collections.defaultdict(list)
            for r in before.values():
                leaves[r["lang"], r["source"]].append(r)
            for own in leaves.values():  # what stays of a leaf is a prefix of its seeded order
                full = [r["doc_id"] in after for r in sorted(own, key=lambda r: hashlib.md5(f"20:0:{r['doc_id']}".encode()).hexdigest())]
                assert full == sorted(full, reverse=True)
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    total = collections.Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    assert total == {i: len(plain(r["text"])) // 4 for i, r in before.items()}
    assert sorted(pieces) == sorted(corpus_pipeline.run(spark, sf_dir).collect())


def test_odd_rows(spark, odd, empty):
    """Nulls, empty and long texts, repeated ids and rows, far ids and clashing columns, stage by stage."""
    out = empty
    for name, stage in corpus_pipeline.STAGES:
        out = stored(stage(spark, out, ""), "test")
        assert out.count() == 0 and (name == "packing" or out.columns == empty.columns)
    docs, counts = odd, lambda df: collections.Counter((r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect())
    every = counts(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = counts(docs), stored(stage(spark, docs, ""), "test")
        after = counts(docs)
        assert docs.columns == odd.columns and not after - (before if name != "secrets" else after)
        assert {r["h"] for r in docs.select("h").distinct().collect()} <= {"clash"}
        if name == "near_duplicates":
            assert (9, "the same text of some words. It ends here.") in after and not any(i == 10 for i, _ in after)
            assert {k for k in before if k[0] is None} <= set(after)  # a row without an id is never a duplicate
        if name == "secrets":
            assert sum(after.values()) == sum(before.values())
        if name == "mixing":
            assert all((t or "").split() for _, t in after) and sum(after.values()) > 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
    total = collections.Counter()
    for r in pieces:
        total[r["doc_id"]] += r["length"]
    want = collections.Counter()
    for (i, text), n in counts(docs).items():
        want[i] += n * (len(plain(text)) // 4)
    assert total == want and sum(every.values()) == len(odd.collect())


def test_secrets_are_replaced(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    after = corpus_pipeline.secrets(spark, docs, "")
    keys = docs.filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).count()
    assert keys > 5 and after.filter(F.col("text").contains('token = "[SECRET]"')).count() == keys
    assert after.filter(F.col("text").rlike('token = "[0-9a-f]{40}"')).count() == 0 and after.count() == docs.count()


def test_rejected_languages(spark, odd):
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, odd, "").select("doc_id").collect()}
    assert not kept & {1, 2, 4, 8} and {9, 10} <= kept
    assert langid.UND == "und"


def test_texts_that_no_language_fits_go(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("lang is not null and n_chars > 300")
    rng = random.Random(3)
    junk = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(n)) for n in (100, 500, 3000) * 10]
    rows = spark.createDataFrame([(10**9 + i, t, None, "s", len(t)) for i, t in enumerate(junk)], docs.schema)
    for left_out in ("de", "fr"):
        unlabelled = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
        kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, unlabelled.unionByName(rows), "").select("doc_id").collect()}
        learned, other = ({r["doc_id"] for r in docs.filter(c).collect()} for c in (F.col("lang") != left_out, F.col("lang") == left_out))
        assert len(kept & learned) >= 0.98 * len(learned) and len(kept & other) <= 0.1 * len(other) and len(other) > 5
        assert max(kept) < 10**9
