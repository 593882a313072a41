"""Every registered query of the training-data operators, as the driver calls it, against its contract."""

import collections
import zlib

import duckdb
import pytest
from test_native_operators import brute_base
from test_token_operators import plain

from tripleloom.llm import queries
from tripleloom.llm.jaccard import ORACLE

COLUMNS = {
    "op1_secrets": "doc_id start length score is_secret candidate_sha256",
    "op2_quality_mil": "doc_id held_out score predicted",
    "op3_lm": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op4_idstore": "doc_id start n_tokens ids_crc32",
    "op5_mixing": "doc_id domain lang source n_tokens full_epochs tokens_taken",
    "op6_jaccard": "doc_id n_shingles component_id",
    "op7_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op8_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
    "op9_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
    "op10_langid": "doc_id held_out lang_pred score",
}
HELD = {"op2_quality_mil": (5, 0), "op3_lm": (7, 2), "op10_langid": (3, 1)}


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_contract(spark, sf_dir, small, name):
    texts = {r["doc_id"]: r["text"] for r in small.select("doc_id", "text").collect()}
    df = queries.QUERIES[name](spark, sf_dir)
    assert set(COLUMNS[name].split()) <= set(df.columns)
    got = df.collect()
    if name == "op1_secrets":
        assert {r["doc_id"] for r in got} <= set(texts) and got and not any(r["is_secret"] for r in got)  # this table holds no key
        more = queries.QUERIES[name](spark, "/root/testdata/sf0.01")
        assert more.filter("is_secret").count() == more.filter("length = 40 and is_secret").count() > 5
        return
    if name == "op9_packing":
        total = collections.Counter()
        for r in got:
            total[r["doc_id"]] += r["length"]
        assert total == {i: len(plain(t)) // 4 for i, t in texts.items()}
        return
    rows = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and set(rows) == set(texts)
    if name in HELD:
        n, rest = HELD[name]
        assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % n == rest) for i, r in rows.items())
    if name == "op4_idstore":
        at = 0
        for i in sorted(rows):
            ids = plain(texts[i])
            assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids_crc32"]) == (at, len(ids) // 4, zlib.crc32(ids))
            at += len(ids) // 4
    if name == "op7_quality_rules":
        for i, r in rows.items():
            n, chars, signs, again, repeated = brute_base(texts[i])
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, signs, again, repeated)
            assert r["base_failed"] == (n < 50 or 100 * repeated > 50 * n) and not (r["kept"] and r["base_failed"])
    if name == "op2_quality_mil":
        assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_links_equal_sql(spark, sf):
    path = f"/root/testdata/{sf}"
    got = queries.QUERIES["op6_jaccard"](spark, path).select("doc_id", "n_shingles", "component_id")
    want = duckdb.connect().execute(ORACLE.replace("FROM documents", f"FROM '{path}/documents.parquet'")).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want)
