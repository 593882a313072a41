"""Token ids, the content-addressed store and packing, against the library and against plain loops."""

import zlib
from dataclasses import replace

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tripleloom.llm import common, idstore, packing
from tripleloom.llm.tokenids import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4").tobytes()


ENCODER = Encoder(PATH, 1)


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("aB'st .!?\n\t<|éÉİ")), max_size=60))
def test_encoder_equals_library(text):
    assert ENCODER.encode(text) == plain(text)


def test_encoder_equals_library_on_documents(small, odd):
    for r in [*small.select("text").collect(), *odd.select("text").collect()]:
        assert ENCODER.encode(r["text"]) == plain(r["text"])


def test_store_returns_every_document(spark, small, odd, empty):
    for docs in (small, odd, empty):
        rows = [(r["doc_id"], plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
        got = idstore.digest_of(idstore.read(spark, idstore.write(docs, PATH))).collect()
        assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((str(i), len(b) // 4, zlib.crc32(b)) for i, b in rows)
        at = 0
        for r in sorted(got, key=lambda r: r["start"]):
            assert r["start"] == at
            at += r["n_tokens"]
        ids = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
        assert ids == sorted(ids, key=lambda i: (i is None, i))


def test_store_keeps_a_chunk_once(spark, odd):
    store = idstore.write(odd, PATH)
    table = spark.table(store.chunks)
    assert table.count() == table.select("chunk_id").distinct().count()
    assert spark.read.parquet(store.manifest).agg({"documents": "sum"}).first()[0] == odd.count()


def test_a_damaged_store_is_noticed(spark, odd):
    store = idstore.write(odd, PATH)
    bad = spark.table(store.chunks).limit(10**6).selectExpr("chunk_id", "concat(body, body) as body")
    bad.write.saveAsTable("damaged_chunks")
    spark.read.parquet(store.hot).limit(0).write.mode("overwrite").parquet(f"{store.hot}-none")
    store = replace(store, hot=f"{store.hot}-none")
    with pytest.raises(Exception, match="differs from its recipe"):
        idstore.read(spark, replace(store, chunks="damaged_chunks", hot=store.hot)).collect()


def test_a_lost_repeated_or_moved_recipe_is_noticed(spark, small, tmp_path):
    store = idstore.write(small, PATH, rows_per_run=40)
    rows = spark.read.schema(idstore.RECIPES).parquet(store.recipes)
    assert spark.read.parquet(store.manifest).count() > 3
    one = rows.orderBy("doc_id").limit(1)
    swapped = rows.withColumn("doc_id", F.when(F.col("doc_id") == 5, 6).when(F.col("doc_id") == 6, 5).otherwise(F.col("doc_id")))
    for k, bad in enumerate((rows.filter("doc_id != 7"), rows.unionByName(one), swapped, rows.filter("run > 0"))):
        bad.write.parquet(f"{tmp_path}/{k}")
        with pytest.raises(ValueError, match="manifest"):
            idstore.read(spark, replace(store, recipes=f"{tmp_path}/{k}"))


@given(st.lists(st.binary(max_size=4), max_size=40))
def test_folding_equals_the_tree(leaves):
    fold = idstore.Fold()
    for x in leaves:
        fold.add(x)
    assert fold.root() == idstore.merkle(leaves)


def test_a_chunk_that_all_documents_use(spark):
    """A third of the rows are one text: its chunks are broadcast, and every row comes back."""
    text = " ".join(f"word{i}" for i in range(300))
    docs = spark.createDataFrame([(i if i % 9 else None, text if i % 3 == 0 else f"text {i} " * 40) for i in range(300)], "doc_id long, text string")
    store = idstore.write(docs, PATH, rows_per_run=10)
    assert 0 < spark.read.parquet(store.hot).count() <= idstore.HOT
    got = idstore.digest_of(idstore.read(spark, store)).collect()
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in got) == sorted((str(r["doc_id"]), zlib.crc32(plain(r["text"]))) for r in docs.collect())
    ends = sorted((r["start"], r["start"] + r["n_tokens"]) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:], strict=False))


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 49407), max_size=3000), st.integers(0, 200))
def test_chunk_cuts(ids, shift):
    ids, gear = np.array(ids, dtype="<u4"), idstore.gear_table()
    h, slow = 0, []
    for x in ids.tolist():
        h = ((h << 1) + int(gear[x])) & 0xFFFFFFFF
        slow.append(h)
    assert idstore.rolling(ids, gear).tolist() == slow
    cuts = idstore.cuts_of(len(ids), idstore.marks_of(ids, gear, 8).tolist(), 64, 1024)
    sizes = np.diff([0, *cuts])
    assert sum(sizes) == len(ids) and (sizes <= 1024).all() and (sizes[:-1] >= 64).all()


def check_packing(docs, size, per_group=200):
    rows = [(r["doc_id"], plain(r["text"])) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack(docs, PATH, size=size, segment_tokens=64 * size, rows_per_group=per_group).collect()
    by_sequence, by_doc = {}, {}
    for r in got:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at and r["length"] > 0
            at += r["length"]
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    want = {}
    for i, b in rows:
        want.setdefault(i, []).append(b)
    for i, texts in want.items():
        pieces = by_doc[i]
        assert sum(r["length"] for r in pieces) == sum(len(b) // 4 for b in texts)
        if len(texts) == 1:
            for r in pieces:
                assert r["doc_tokens"] == len(texts[0]) // 4
                assert r["ids_crc32"] == zlib.crc32(texts[0][4 * r["start"] : 4 * (r["start"] + r["length"])])
    return padding / max(1, sum(len(b) // 4 for _, b in rows))


def test_packing(small, odd, empty):
    assert check_packing(small, 2048) < 0.02
    check_packing(odd, 2048)
    check_packing(odd, 256)
    check_packing(odd, 256, per_group=1)
    check_packing(small, 512, per_group=20)
    assert packing.pack(empty, PATH).collect() == []


def test_groups_do_not_depend_on_the_spacing_of_ids(spark):
    """Far outliers, one id with a third of the rows and null ids: groups stay even, and in order."""
    far = [2**50, -(2**40), 2**50 + 1]
    ids = [*range(3000), *far, *([77] * 1500), *([None] * 900)]
    docs = spark.createDataFrame([(i,) for i in ids], "doc_id long").repartition(3)
    bounds, nulls = common.id_groups(docs, rows=100)
    values = pa.array(ids, pa.int64())
    part = common.group_numbers(values, bounds, nulls, 5)
    sizes = np.bincount(part)
    assert 40 <= len(sizes) <= 60 and sizes.max() <= 250
    order = sorted((int(p), i is None, i or 0) for i, p in zip(ids, part, strict=True))
    named = [i for _, none, i in order if not none]
    assert named == sorted(named) and not any(none for _, none, _ in order[:-900])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 90), min_size=1, max_size=14), st.integers(0, 10**6))
def test_cuts_are_the_best(gaps, seed):
    """The monotone queue finds the same cost as trying every earlier cut."""
    size, rng = 100, np.random.default_rng(seed)
    positions = [0, *np.cumsum(gaps).tolist()]
    penalties = rng.choice([0.0, 12.0, 60.0], len(positions)).tolist()
    pad = lambda n: 0 if n & (n - 1) == 0 and n >= 64 else size - n
    best = [0.0]
    for j in range(1, len(positions)):
        best.append(min(best[i] + pad(positions[j] - positions[i]) for i in range(j) if positions[j] - positions[i] <= size) + penalties[j])
    cuts = packing.cut_windows(positions, penalties, size)
    cost = sum(pad(b - a) + penalties[positions.index(b)] for a, b in zip(cuts, cuts[1:], strict=False))
    assert cuts[0] == 0 and cuts[-1] == positions[-1] and cost == pytest.approx(best[-1])
