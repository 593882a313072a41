"""The Jaccard join against all pairs by plain sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

from tripleloom.llm import jaccard


def brute(rows, n, percent):
    """{doc_id: component} and sizes by plain loops over all pairs."""
    sets = []
    for i, text in rows:
        words = tuple((text or "").encode().lower().split())
        size = min(n, len(words))
        sets.append((i, {words[k : k + size] for k in range(len(words) - size + 1)} if size else set()))
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(sets):
        for j, y in sets[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: root(i) for i in up}, [(i, len(s)) for i, s in sets]


def plain_shingles(text, n):
    words = tuple((text or "").encode().lower().split())
    size = min(n, len(words))
    return {words[k : k + size] for k in range(len(words) - size + 1)} if size else set()


def check(docs, n, percent, **more):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    comps, sizes = brute([r for r in rows if r[0] is not None], n, percent)
    got = jaccard.join(docs, n, percent, **more).collect()
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted(sizes)
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None} == comps
    return comps


def edited(words, rate, rng, fresh):
    return " ".join(f"new{next(fresh)}" if rng.random() < rate else w for w in words)


@pytest.fixture(scope="module")
def groups(spark):
    """Near copies at every distance round the threshold, small sets, and texts that share one passage."""
    rng, fresh, rows = random.Random(5), iter(range(10**9)), []
    passage = " ".join(f"p{i}" for i in range(60))
    for _ in range(30):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.choice([2, 5, 9, 30, 120, 400]))]
        for _ in range(rng.randrange(1, 12)):
            rows.append(edited(base, rng.choice([0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1]), rng, fresh))
    for _ in range(40):
        rows.append(" ".join(f"w{rng.randrange(4000)}" for _ in range(rng.randrange(40))) + " " + passage)
    rng.shuffle(rows)
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")


def test_equals_all_pairs(groups):
    comps = check(groups, 3, 90)
    assert 20 < len(set(comps.values())) < len(comps)
    check(groups, 5, 80)


def test_blocks_equal_one_tile(groups):
    check(groups, 3, 90, tile_docs=3)
    check(groups, 5, 80, tile_docs=2)


def test_small_table(small):
    check(small, 3, 90)


def test_edges(odd, empty):
    check(odd, 3, 90)
    got = jaccard.join(odd, 3, 90).collect()
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {None}
    assert jaccard.join(empty, 3, 90).collect() == []


def test_linked_sets_share_a_key():
    """Any two sets at the threshold share a key, whichever shingles are common."""
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        bands = jaccard.Bands(percent)
        for trial in range(300):
            n = int(rng.integers(1, 300))
            base = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            most = int((100 - percent) * len(base) // 100)
            cut = int(rng.integers(0, most + 1))
            other = np.unique(np.concatenate([base[cut:], rng.integers(0, 1 << 63, int(rng.integers(0, most - cut + 1))).astype(np.uint64)]))
            common = np.intersect1d(base, other)
            if not len(other) or 100 * len(common) < percent * len(np.union1d(base, other)):
                continue
            flags = rng.random(jaccard.COUNTERS) < rng.choice([0, 0.1, 0.5, 0.9, 1])
            key, owner = jaccard.part_keys(np.concatenate([base, other]), np.array([len(base), len(other)]), bands, flags)
            assert set(key[owner == 0].tolist()) & set(key[owner == 1].tolist()), (percent, trial)


def test_whole_sequence_of_few_words():
    flat, sizes = jaccard.shingle_sets(pa.array(["One two", "one  TWO\n", None, "one two three"]), 3)
    a, b, c = flat.tolist()
    assert sizes.tolist() == [1, 1, 0, 1] and a == b != c


def test_shingles_equal_plain_sets():
    texts = ["a b c d a b c d e", "", None, "x", "A b\tc\x0bD  A", "é É " * 5, "w" * 40_000 + " b c " + "W" * 40_000]
    flat, sizes = jaccard.shingle_sets(pa.array(texts), 3)
    _, want = brute(list(enumerate(texts)), 3, 90)
    assert sizes.tolist() == [n for _, n in want]
    assert len(set(flat.tolist())) == len({w for t in texts for w in plain_shingles(t, 3)})


def test_long_sets_have_bands():
    bands = jaccard.Bands(90)
    sizes = np.array([5, 1 << 20])
    flat = np.concatenate([np.arange(5), np.arange(1 << 20)]).astype(np.uint64) * jaccard.GOLD
    key, owner = jaccard.part_keys(flat, sizes, bands, np.zeros(jaccard.COUNTERS, dtype=bool))
    assert bands.edges[-1] > 1 << 20 and len(key) == len(set(key.tolist())) and set(owner.tolist()) == {0, 1}


@pytest.mark.parametrize("tile_docs", [3, 2000])
def test_ids_with_rows_of_different_sizes(spark, tile_docs):
    """Id 50 has a row in each of two groups of near copies, and so joins them, in one tile or in many."""
    rng = random.Random(8)
    long, short = ([f"v{rng.randrange(10**6)}" for _ in range(n)] for n in (400, 60))
    near = lambda words, k: " ".join([*words, f"x{k}"])
    rows = [(i, near(long, i)) for i in range(1, 13)] + [(i, near(short, i)) for i in range(101, 113)] + [(50, near(long, 50)), (50, near(short, 50))]
    rows += [(60, near(long, 1)), (60, " ".join(f"u{i}" for i in range(401))), (300, " ".join(f"u{i}" for i in range(402)))]  # a copy that is also something else
    comps = check(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, tile_docs=tile_docs)
    assert set(comps.values()) == {1}


def test_rows_are_split_by_ids(spark):
    rows = spark.createDataFrame([(i if i % 7 else None, "x", i) for i in range(2000)], "doc_id int, text string, word long")
    sure, may = jaccard.split_by_ids(rows, spark.createDataFrame([(i,) for i in range(0, 4000, 5)], "doc_id long"))
    assert sure.columns == may.columns == rows.columns
    there = {r["word"] for r in may.collect()}
    assert there >= {i for i in range(2000) if i % 5 == 0 and i % 7} and len(there) < 360
    assert {r["word"] for r in sure.collect()} == set(range(2000)) - there


def test_chain_of_components(spark):
    rng = random.Random(2)
    order = rng.sample(range(300), 300)
    edges = [(min(a, b), max(a, b)) for a, b in zip(order, order[1:], strict=False) if a % 50 or b % 50]
    frame = spark.createDataFrame(edges, "a long, b long")
    got, alone = (sorted(jaccard.components(frame, n).collect()) for n in (20, 10**6))
    assert got == alone and len({r["node"] for r in got}) == len(got)
    up = list(range(300))
    for a, b in edges * 300:
        low = min(up[a], up[b])
        up[a] = up[b] = low
    assert all(up[r["node"]] == r["comp"] for r in got)


def test_chance_ties_do_not_meet_in_tiles(spark, monkeypatch):
    """Unlike texts that share some words are tied by equal parts; before tiles are made they part again, and no link is lost."""
    rng = random.Random(3)
    texts = [" ".join([f"own{i}x{j}" for j in range(4)] + rng.sample([f"pool{k}" for k in range(120)], 8)) for i in range(400)]
    texts += [t + " more" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    met, links = [], jaccard.links
    monkeypatch.setattr(jaccard, "links", lambda docs, tiles, n, percent: met.append(tiles.count()) or links(docs, tiles, n, percent))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, n=1, percent=80, tile_docs=16).collect()}
    assert got == {i: i - 400 if i >= 400 else i for i in range(420)}
    assert sum(met) < 420


def test_counters_of_a_task_are_few_rows(spark):
    """However many texts and shingles a task has, it passes its counters on in CHUNKS rows, and they are counts up to 255."""
    rng = random.Random(4)
    texts = [" ".join(["all", f"own{i}", *rng.sample([f"pool{k}" for k in range(500)], 40)]) for i in range(1500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    tasks = docs.rdd.getNumPartitions()
    for width in (1 << 10, 1 << 20):  # full chunks, and chunks with few counters set
        flat, _ = jaccard.shingle_sets(pa.array(texts), 1)
        want = np.minimum(np.bincount((flat & np.uint64(width - 1)).astype(np.int64), minlength=width), 255)
        assert (jaccard.shingle_counters(docs, 1, width) == want).all() and want.max() == 255
        assert jaccard.task_counters(docs, 1, width).count() <= tasks * jaccard.CHUNKS


def test_few_counters_leave_chance_ties_apart(spark, monkeypatch):
    """Texts that share a passage with the next one, far under the bound, are parted also where the counters tell no shingle from another; near copies are not."""
    monkeypatch.setattr(jaccard, "ORDER_BYTES", 64)
    rng = random.Random(7)
    texts = [[f"w{rng.randrange(10**9)}" for _ in range(300)] for _ in range(40)]
    for a, b in zip(texts, texts[1:], strict=False):
        b[:15] = a[-15:]
    texts.append([*texts[20][:150], "new", *texts[20][150:]])
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    members = spark.createDataFrame([(i, 1, len(t) - 4) for i, t in enumerate(texts)], "doc_id long, comp long, n long")
    groups = {}
    for r in jaccard.parted(docs, members, 5, 80, 1).collect():
        groups.setdefault(r["comp"], set()).add(r["doc_id"])
    assert [g for g in groups.values() if len(g) > 1] == [{20, 40}]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.join(docs, 5, 80, tile_docs=1).collect()}
    assert got == {i: 20 if i == 40 else i for i in range(41)}
