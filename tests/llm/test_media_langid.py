"""MPEG media: exact round trips and damaged streams. Language ID: held-out accuracy."""

import collections
import hashlib
import struct
import zlib
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tripleloom.llm import langid, media


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=6000))
def test_payload_round_trip(data):
    stored = media.pack(data)
    parsed = media.parse(stored)
    assert media.unpack(stored, parsed) == data
    assert parsed.skipped == parsed.crc_errors == 0
    assert parsed.table["frames"] == len(parsed.frames)
    assert parsed.duration == Fraction(1152 * len(parsed.frames), 32000)


def test_resynchronises_and_verifies():
    stored = media.pack(bytes(range(256)) * 40)
    frames = media.parse(stored).frames
    third = frames[2][0]
    broken = stored[:third] + b"\xff\x00junk\xff\xfa" + stored[third:]
    parsed = media.parse(broken)
    assert len(parsed.frames) == len(frames) and parsed.skipped == 8
    flipped = bytearray(stored)
    flipped[frames[1][0] + 8] ^= 1  # in the side information, which the checksum covers
    assert media.parse(bytes(flipped)).crc_errors == 1
    tagged = stored + b"TAG" + b"a title".ljust(125, b"\0")
    assert media.parse(tagged).tags["ID3v1"] == "a title" and media.parse(tagged).skipped == 0
    assert media.parse(b"").frames == [] and media.parse(b"\xff" * 50).frames == []


def test_headers_of_other_kinds():
    assert media.header(bytes([0xFF, 0xFB, 0x90, 0x00])).size == 417  # MPEG-1 layer III, 128 kbit/s, 44100 Hz
    assert media.header(bytes([0xFF, 0xF3, 0x80, 0xC0])).samples == 576  # MPEG-2 layer III
    assert media.header(bytes([0xFF, 0xFF, 0x10, 0x00])).samples == 384  # layer I
    assert media.header(bytes([0xFF, 0xFB, 0xF0, 0x00])) is None


def crc_bits(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ 0x8005 if (crc >> 15) ^ b else crc << 1) & 0xFFFF
    return crc


def bit_list(data):
    return [x >> (7 - k) & 1 for x in data for k in range(8)]


def test_checksums_of_layers_one_and_two():
    """Frames whose covered bits are counted here by the format's text."""
    rng = np.random.default_rng(1)
    # layer I, 32 kHz, 64 kbit/s, stereo: 256 bits of allocation
    head = bytes([0xFF, 0xFE, 0x28, 0x00])
    body = rng.integers(0, 256, media.header(head).size - 6, dtype=np.uint8).tobytes()
    frame = head + crc_bits(bit_list(head[2:] + body[:32])).to_bytes(2, "big") + body
    got = media.parse(frame * 3)
    assert (got.protected, got.crc_errors, len(got.frames)) == (3, 0, 3) and got.duration == Fraction(3 * 384, 32000)
    assert media.parse(frame[:6] + bytes([frame[6] ^ 1]) + frame[7:] + frame).crc_errors == 1
    # layer II, 44.1 kHz, 192 kbit/s, mono (30 subbands): 11 x 4 + 12 x 3 + 7 x 2 = 94 bits, and 2 for each subband in use
    head = bytes([0xFF, 0xFC, 0xA0, 0xC0])
    size = media.header(head).size
    body = rng.integers(0, 256, size - 6, dtype=np.uint8).tobytes()
    bits, at, used = bit_list(body), 0, 0
    for width in [4] * 11 + [3] * 12 + [2] * 7:
        used += any(bits[at : at + width])
        at += width
    assert at == 94
    frame = head + crc_bits(bit_list(head[2:]) + bits[: at + 2 * used]).to_bytes(2, "big") + body
    got = media.parse(frame * 2)
    assert (got.protected, got.crc_errors, len(got.frames)) == (2, 0, 2)


def test_tags_of_all_versions():
    frame = bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)
    tag = lambda major, flags, body: b"ID3" + bytes([major, 0, flags, 0, 0, len(body) >> 7, len(body) & 127]) + body
    two = tag(2, 0, b"TT2" + bytes([0, 0, 6]) + b"\0title")
    three = tag(3, 0x80, b"TIT2" + bytes([0, 0, 0, 4, 0, 0]) + b"\0a\xff\x00b")  # unsynchronised
    extended = tag(3, 0x40, bytes([0, 0, 0, 6, 0, 0, 0, 0, 0, 0]) + b"TIT2" + bytes([0, 0, 0, 2, 0, 0]) + b"\0x")
    four = tag(4, 0x10, b"TIT2" + bytes([0, 0, 0, 3, 0, 0]) + b"\3\xc3\xa9") + b"3DI" + bytes([4, 0, 0x10, 0, 0, 0, 13])
    for data, tags in ((two, {"TT2": "title"}), (three, {"TIT2": "a\xffb"}), (extended, {"TIT2": "x"}), (four, {"TIT2": "é"})):
        got = media.parse(data + frame * 2)
        assert got.tags == tags and len(got.frames) == 2 and got.skipped == 0 and got.frames[0][0] == len(data)


def test_tables_of_variable_bitrates():
    head = bytes([0xFF, 0xFB, 0x90, 0x00])
    vbri = head + bytes(32) + b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 70, 5 * 417, 4, 4, 2, 2, 1) + struct.pack(">4H", *[417 // 2] * 4)
    got = media.parse(vbri.ljust(417, b"\0") + (head + bytes(413)) * 4)
    assert got.table["frames"] == 4 and len(got.frames) == 4 and got.seek == [417 + i * 416 for i in range(4)]
    data = media.pack(bytes(30_000))
    got = media.parse(data)
    assert len(got.seek) == 100 and got.seek == sorted(got.seek) and got.seek[-1] < len(data)


def test_media_of_any_origin(spark):
    """Null, empty, junk, foreign and cut-off media have defined features and never stop a job."""
    mp3 = (bytes([0xFF, 0xFB, 0x90, 0x00]) + bytes(413)) * 5
    ours = media.pack(b"some payload" * 300)
    broken = b"ID3\3\0\0\x7f\x7f\x7f\x7fTXXX"
    rows = [(1, 9, None), (2, 9, b""), (3, 9, b"junk " * 50), (4, 9, mp3), (5, 9, ours[:-900]), (6, None, ours), (7, 9, broken), (8, 9, b"\xff" * 3000)]
    got = {r["doc_id"]: r for r in media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1]["feature"] is None and got[1]["media_bytes"] is None
    assert [got[i]["frames"] for i in (2, 3, 4, 7, 8)] == [0, 0, 5, 0, 0] and got[4]["duration_s"] == 5 * 1152 / 44100
    assert [got[i]["payload_sha256"] for i in (2, 3, 4, 5, 7)] == [None] * 5
    assert got[6]["payload_sha256"] == hashlib.sha256(b"some payload" * 300).hexdigest()


def test_stored_offsets_are_those_of_the_frames(small):
    rows = media.media_table(small).collect()
    for r in rows:
        parsed = media.parse(r["media"])
        assert r["seek_offsets"] == [at for at, _ in parsed.frames]
        assert parsed.duration == Fraction(r["samples"], r["sample_rate"])


def test_media_table(small, odd, empty):
    for docs in (small, odd):
        want = []
        for r in docs.select("doc_id", "text").collect():
            raw = (r["text"] or "").encode()
            payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
            want.append((str(r["doc_id"]), len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
        got = media.store_and_read(docs).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
        values = {}
        for r in got:
            values.setdefault(r["payload_sha256"] + str(r["n_bytes"]), set()).add((r["media_sha256"], r["feature"], r["media_bytes"]))
        assert all(len(v) == 1 for v in values.values())
    assert media.store_and_read(empty).collect() == []


def test_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 = 1"))
    got = langid.identify(docs, ~F.col("held_out"), ["doc_id", "held_out", "lang"]).filter("held_out").collect()
    assert len(got) > 250
    assert sum(r["lang"] == r["lang_pred"] for r in got) / len(got) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_edges(odd, empty, small):
    got = langid.identify(odd, F.lit(True), ["doc_id"]).collect()
    assert len(got) == odd.count()
    said = {(r["doc_id"], r["lang_pred"]) for r in got}
    assert {(1, "und"), (2, "und"), (4, "und"), (8, "und")} <= said and (9, "und") not in said
    assert langid.identify(empty, F.lit(True), ["doc_id"]).collect() == []
    assert {r["lang_pred"] for r in langid.identify(small, F.lit(False), ["doc_id"]).collect()} == {"und"}


def plain_bundle(text, dims, seed):
    """By a plain loop over letters; 0 stands for a run of anything else."""
    letters = [0]
    for ch in text:
        code = ord(ch.lower()[0]) if ch.isalpha() else 0
        if code or letters[-1]:
            letters.append(code)
    if letters[-1]:
        letters.append(0)
    vector = {c: langid.letter_vectors(np.array([c]), dims, seed)[0].astype(int) for c in set(letters)}
    total = np.zeros(dims)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        if b:
            total += np.roll(vector[a], 2) * np.roll(vector[b], 1) * vector[c]
    return total


TEXTS = ["Ab cé, ab", "", "12", "в м е к щ", "ß é ç ö", "日本語 日本", "\U00010400x \U00010428X", "a", "  word  "]


def test_bundles_equal_a_plain_loop(monkeypatch):
    for cells in (1 << 20, 4):
        monkeypatch.setattr(langid, "CELLS", cells)
        rows, grams, counts, has = langid.gram_counts(TEXTS)
        got = langid.bundles(rows, grams, counts, len(TEXTS), 256, 3)
        assert (got == np.array([plain_bundle(t, 256, 3) for t in TEXTS])).all()
    assert has.tolist() == [any(c.isalpha() for c in t) for t in TEXTS]


def test_letters_of_all_scripts_differ():
    codes = np.unique(langid.lower_letters())
    vectors = np.packbits(langid.letter_vectors(codes, 256, 11) > 0, axis=1)
    assert len(np.unique(vectors, axis=0)) == len(codes) > 40_000


def test_predictions_equal_plain_python(small):
    """Profiles, predictions and scores of all documents by plain loops."""
    docs = [r.asDict() for r in small.select("doc_id", "text", "lang").collect()]
    sums, n = {}, collections.Counter()
    vectors = {r["doc_id"]: plain_bundle(r["text"] or "", 64, 5) for r in docs}
    for r in docs:
        has = any(c.isalpha() for c in r["text"] or "")
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1 and r["lang"] is not None and r["text"] is not None:
            grams = langid.gram_counts([r["text"]])[2].sum()
            sums[r["lang"]] = sums.get(r["lang"], 0) + vectors[r["doc_id"]] / max(1, grams)
            n[r["lang"]] += has
    names = sorted(sums)
    profiles = langid.unit(np.array([sums[x] / n[x] for x in names]))
    middle = profiles.mean(axis=0)
    got = langid.identify(small, F.expr("crc32(cast(cast(doc_id as string) as binary)) % 3 != 1"), ["doc_id"], dims=64, seed=5).collect()
    assert len(got) == len(docs)
    for r in got:
        if r["lang_pred"] == "und":
            continue
        cosine = langid.unit(langid.unit(vectors[r["doc_id"]]) - middle) @ langid.unit(profiles - middle).T
        assert abs((1 + cosine.max()) / 2 - r["score"]) < 1e-4 and cosine[names.index(r["lang_pred"])] > cosine.max() - 1e-4


def test_many_languages_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 3)
    docs = spark.createDataFrame([(i, "some words", f"l{i}") for i in range(8)], "doc_id long, text string, lang string")
    with pytest.raises(Exception, match="more than 3 values"):
        langid.learn(docs, F.lit(True), 64, 1)
    assert len(langid.learn(docs.filter("doc_id < 3"), F.lit(True), 64, 1)[0]) == 3


def test_short_random_texts_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(0)
    texts = ["".join(map(chr, rng.integers(0x4E00, 0x9000, 60))) for _ in range(2000)]
    tracemalloc.start()
    rows, grams, counts, _ = langid.gram_counts(texts)
    langid.bundles(rows, grams, counts, len(texts), 1024, 1)
    assert tracemalloc.get_traced_memory()[1] < 120 << 20
    tracemalloc.stop()
