"""Hand-computed cases for the graph engine."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tripleloom.functions import extract, text, vector
from tripleloom.operators import communities, fuzzy, history, ingest, maintain, nearest, pagerank, reason, resolve, retrieve, search, steiner, vector_index
from tripleloom.schema import BATCH, DAY_MS, Params
from tripleloom.sources.store import Store, duplicates, empty, list_nodes, triples

NOW = 1_700_000_000_000


def batch_of(spark, rows):
    """rows: (subject, original, embedding, relation, object, context)"""
    data = [(i, (s, o, e), (r, [1.0, 0.0]), (t, t, [0.0, 1.0]), (c, "src", None, None)) for i, (s, o, e, r, t, c) in enumerate(rows)]
    return spark.createDataFrame(data, BATCH)


def graph_of(spark, facts, now=NOW):
    return ingest.upsert(empty(spark), batch_of(spark, [(s, s, [1.0, 0.0], r, o, c) for s, r, o, c in facts]), now, Params())


# ---- decay, ranking ----


def test_decay(spark):
    rows = spark.createDataFrame([(d, NOW - d * DAY_MS) for d in (0, 1, 7, 14, 30)], "d int, c long")
    got = [round(r[0], 6) for r in rows.orderBy("d").select(maintain.decayed(F.col("c"), NOW, 0.05)).collect()]
    assert got == [1.0, 0.951229, 0.704688, 0.496585, 0.22313]


def both_ways(spark, edges):
    return spark.createDataFrame([(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges], "src string, dst string, w double")


@pytest.mark.parametrize("kernel_edges", [0, 10**6])
def test_pagerank(spark, kernel_edges):
    seeds = spark.createDataFrame([("A",), ("A",)], "node string")
    path = both_ways(spark, [("A", "e1", 1.0), ("e1", "B", 1.0)])
    got = {r["node"]: round(r["score"], 6) for r in pagerank.pagerank(path, seeds, kernel_edges=kernel_edges).collect()}
    assert got == {"A": 0.337702, "e1": 0.441651, "B": 0.187702}
    triangle = both_ways(spark, [("A", "e1", 1.0), ("e1", "B", 1.0), ("A", "e2", 0.5), ("e2", "C", 0.5), ("B", "e3", 1.0), ("e3", "C", 1.0)])
    got = {r["node"]: round(r["score"], 6) for r in pagerank.pagerank(triangle, seeds, kernel_edges=kernel_edges).collect()}
    assert got == {"A": 0.290521, "e1": 0.222979, "B": 0.141947, "e3": 0.111014, "e2": 0.107658, "C": 0.092936}


def test_hubs_are_dealt_out(spark):
    """A star's centre in many turns gives the same ranks as in one."""
    star = both_ways(spark, [("hub", f"n{i}", 1.0 + i % 3) for i in range(60)] + [(f"n{i}", f"n{i + 1}", 0.5) for i in range(0, 50, 5)])
    seeds = spark.createDataFrame([("n3",)], "node string")
    steps = pagerank.transitions(star)
    rows = [sorted((r["node"], round(r["score"], 12)) for r in x.collect()) for x in (pagerank.kernel(steps, seeds, 0.85, 6), pagerank.loop(steps, seeds, 0.85, 6, 140, cut=4, hub_edges=10))]
    assert rows[0] == rows[1] and len(rows[0]) == 61


def test_vector_index(spark, tmp_path):
    """Lists pruned at the scan, recall of at least 0.9 with few probes, exact with all, and odd rows."""
    rng = np.random.default_rng(3)
    middles = rng.standard_normal((20, 16))
    x = middles[rng.integers(0, 20, 1500)] + 0.4 * rng.standard_normal((1500, 16))
    rows = spark.createDataFrame([(f"k{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("zero", [0.0] * 16)], "text string, embedding array<double>")
    vector_index.build(rows, "text", f"file://{tmp_path}/index", lists=30)
    index = vector_index.load(spark, f"file://{tmp_path}/index")
    assert index.rows().count() == 1500
    asked = rows.filter("text like 'k_00' or text in ('k7', 'none', 'zero')").withColumnRenamed("text", "qkey")
    exact = {(r["qkey"], r["ckey"]) for r in nearest.nearest(asked, rows.withColumnRenamed("text", "ckey"), 10, "raw").collect()}
    for probes, least in ((6, 0.9), (30, 1.0)):
        got = {(r["qkey"], r["ckey"]) for r in vector_index.nearest(asked, index, 10, probes, "raw", block=64).collect()}
        assert len(exact & got) >= least * len(exact)
    one = vector_index.top_k(index, x[7].tolist(), 3, probes=2, mode="raw")
    assert one.first()["key"] == "k7" and "PartitionFilters: [list" in one._jdf.queryExecution().executedPlan().toString()
    none = vector_index.build(rows.filter("text in ('none', 'zero')"), "text", f"file://{tmp_path}/empty")
    assert vector_index.top_k(none, [1.0] * 16, 3).collect() == [] and vector_index.nearest(asked, none, 3).collect() == []


def test_a_token_that_all_entities_hold(spark, tmp_path):
    """The best of many entities of one token are the first by name, with an index or without."""
    entities = spark.createDataFrame([(f"the thing {i:04d}",) for i in range(400)] + [("thee only",), (None,)], "text string")
    asked = spark.createDataFrame([("q", "the"), ("r", "0399x")], "qkey string, text string")
    plain = [tuple(r) for r in fuzzy.fuzzy_hits(asked, entities, 3).orderBy("qkey", "rank").select("qkey", "entity", "rank").collect()]
    assert plain[:3] == [("q", f"the thing {i:04d}", i + 1) for i in range(3)] and plain[3][:2] == ("r", "the thing 0399")
    index = fuzzy.build_index(entities, f"file://{tmp_path}/text")
    assert [tuple(r) for r in fuzzy.fuzzy_hits(asked, index, 3).orderBy("qkey", "rank").select("qkey", "entity", "rank").collect()] == plain


def test_no_seeds_no_ranks(spark):
    path = both_ways(spark, [("A", "B", 1.0)])
    assert pagerank.pagerank(path, spark.createDataFrame([], "node string")).collect() == []


# ---- resolution ----


def test_spelling_ratio(spark):
    pairs = [("심청", "심청이"), ("세종대왕", "세종대왕이"), ("abcdefg", "abcdefgh"), ("tide", "diet"), ("diet", "tide"), (None, "a")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").select(text.sequence_ratio(F.col("a"), F.col("b"))).collect()]
    assert [None if x is None else round(x, 6) for x in got] == [0.8, 0.888889, 0.933333, 0.25, 0.5, None]


def test_resolution_order(spark):
    entities = spark.createDataFrame([("near", [1.0, 0.0]), ("spelled", [0.0, 1.0]), ("spelledx", [0.0, -1.0])], "text string, embedding array<double>")
    mentions = [
        ("m1", "near", None),  # no vector: unchanged, even where the text exists
        ("m2", "spelled", [1.0, 0.01]),  # a vector match wins over a better spelling
        ("m3", "spellee", [-1.0, 0.0]),  # by spelling
        ("m4", "n", [-1.0, 0.0]),  # too short for spelling
        ("m5", "something else", [-1.0, 0.0]),
        ("m6", "twin", [-1.0, 0.02]),
        ("m7", "twins", [-1.0, 0.02]),  # mentions never resolve to each other
    ]
    got = {r["mention"]: (r["resolved"], r["how"]) for r in resolve.resolve(spark.createDataFrame(mentions, "mention string, text string, embedding array<double>"), entities, Params()).collect()}
    assert got == {"m1": ("near", "new"), "m2": ("near", "vector"), "m3": ("spelled", "spelling"), "m4": ("n", "new"), "m5": ("something else", "new"), "m6": ("twin", "new"), "m7": ("twins", "new")}


def test_close_tokens_are_complete(spark):
    rng = random.Random(4)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 7))) for _ in range(120)})
    q, t = (spark.createDataFrame([(w,) for w in ws], "token string") for ws in (words[::3], words))

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        return row[-1]

    want = {(a, b, distance(a, b)) for a in words[::3] for b in words if distance(a, b) <= 2}
    assert {tuple(r) for r in fuzzy.close_tokens(q, t).select("query", "token", "distance").collect()} == want


def test_nearest_by_blocks(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((60, 5))
    rows = [(f"k{i}", v.tolist()) for i, v in enumerate(x)] + [("none", None), ("zero", [0.0] * 5)]
    q, c = (spark.createDataFrame(rows, f"{k} string, embedding array<double>") for k in ("qkey", "ckey"))
    got = {(r["qkey"], r["rank"]): r["ckey"] for r in nearest.nearest(q, c, 4, "raw", block=13).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(f"k{i}", j + 1): f"k{b}" for i in range(60) for j, b in enumerate(np.argsort(-(u[i] @ u.T))[:4])}
    assert got == want


# ---- upsert ----


def test_upsert_policies(spark):
    e = ([0.0], [1.0], [2.0], [3.0])
    batch = batch_of(spark, [("X", "x1", e[1], "r1", "o", None), ("X", "x2", e[2], "r2", "o", None), ("X", "x1", e[3], "r3", "o", None)])
    held = spark.createDataFrame([("X", e[0], 5, [], None)], "text string, embedding array<double>, created_at long, synonyms array<string>, community_id long")
    none = empty(spark).entities
    for old, params, want in ((held, Params.v1(), ([3.0], ["x1", "x2"])), (held, Params.v2(), ([0.0], ["x1", "x2"])), (none, Params.v1(), ([3.0], ["x1", "x2"])), (none, Params.v2(), ([1.0], ["x2", "x1"]))):
        once = ingest.upsert_entities(old, batch, NOW, params)
        row = once.filter("text = 'X'").first()
        assert (row["embedding"], row["synonyms"]) == want
        assert row["created_at"] == (5 if old is held else NOW)


def test_upsert_again_adds_nothing(spark):
    batch = batch_of(spark, [("A", "a", [1.0], "likes", "B", "said one"), ("C", "c", [1.0], "likes", "D", "said two"), ("A", "A", [1.0], "likes", "B", "said one")])
    once = ingest.upsert(empty(spark), batch, NOW, Params())
    twice = ingest.upsert(once, batch, NOW + 5, Params())
    for name in ("entities", "events", "contexts", "edges_source", "edges_target", "edges_derived"):
        assert sorted(map(str, getattr(once, name).collect())) == sorted(map(str, getattr(twice, name).collect())), name
    assert {tuple(r) for r in triples(once).collect()} == {(s, "likes", o) for s in "AC" for o in "BD"}
    assert once.contexts.count() == 2 and once.events.count() == 1


def test_edges_keep_their_weight(spark):
    old = spark.createDataFrame([("a", "e", 0.5)], "entity string, event string, weight double")
    new = spark.createDataFrame([("a", "e", None), ("b", "e", None), ("b", "e", None)], old.schema)
    assert sorted(map(tuple, ingest.merge_edges(old, new, ["entity", "event"]).collect()), key=str) == [("a", "e", 0.5), ("b", "e", None)]


# ---- store ----


def test_store_versions(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.version() == 0 and s.load().entities.count() == 0
    g = graph_of(spark, [("A", "e1", "B", "c1")])
    assert s.commit(g, check=True) == 1
    assert s.load().entities.count() == 2
    bad = g.having(entities=g.entities.unionByName(g.entities))
    with pytest.raises(ValueError, match="entities repeats"):
        s.commit(bad, check=True)
    assert s.version() == 1  # the refused version has no marker
    assert s.clear() == 2 and s.load().entities.count() == 0 and s.load(1).entities.count() == 2
    assert [r["text"] for r in list_nodes(s.load(1), 3).collect()] == ["c1", "A", "B"]
    assert duplicates(bad.entities, ["text"]).count() == 2


def test_store_prunes_and_closes(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    g = graph_of(spark, [("A", "e1", "B", "c1")])
    for _ in range(3):
        s.commit(g)
    assert s.prune(2) == [1] and s.version() == 3 and s.load(2).entities.count() == 2
    s.close()
    for call in (s.health, lambda: s.commit(g)):
        with pytest.raises(ValueError, match="closed"):
            call()


# ---- search, update, delete ----


def test_delete(spark):
    g = graph_of(spark, [("A", "e1", "B", "c1"), ("A", "e2", "C", "c2")])
    after = search.delete_events(g, spark.createDataFrame([("e1",)], "text string"))
    assert {r["text"] for r in after.entities.collect()} == {"A", "C"}
    assert {r["text"] for r in after.events.collect()} == {"e2"} and after.contexts.count() == 2


def update_graph(spark, s, e, o):
    """One fact whose parts have these cosines with the asked vectors."""
    unit = lambda c: [c, math.sqrt(1 - c * c)]
    data = [(0, ("S", "S", unit(s)), ("lives in", unit(e)), ("O", "O", [-unit(o)[0], unit(o)[1]]), None)]
    return ingest.upsert(empty(spark), spark.createDataFrame(data, BATCH), NOW - 5, Params())


@pytest.mark.parametrize(("scores", "applied"), [((0.95, 0.9, 0.9), True), ((0.95, 0.9, 0.81), False)])
def test_update(spark, scores, applied):
    g = update_graph(spark, scores[0], scores[2], scores[1])
    change = search.Change([1.0, 0.0], [-1.0, 0.0], "moved to", [1.0, 0.0], "N", [0.0, 1.0], "q")
    p = Params(score_mode="raw")
    after = search.update(g, change, NOW, p)
    got = {r["text"]: (r["is_current"], r["end_date"] is not None) for r in after.events.collect()}
    assert got == ({"lives in": (False, True), "moved to": (True, False)} if applied else {"lives in": (True, False)})
    if applied:
        again = search.update(after, change, NOW + 1, p)  # the expired fact is no candidate, and N is no old object
        assert again.events.count() == 2
        assert ("S", "moved to", "N") in {tuple(r) for r in triples(after).collect()}


@pytest.mark.parametrize("strict", [False, True])
def test_update_with_the_same_relation(spark, strict):
    g = update_graph(spark, 0.99, 0.99, 0.99)
    change = search.Change([1.0, 0.0], [-1.0, 0.0], "lives in", [1.0, 0.0], "N", [0.0, 1.0], "q")
    after = search.update(g, change, NOW, Params(score_mode="raw"), strict=strict)
    row = after.events.first()
    assert row["is_current"] is (not strict) and row["source_queries"] == ["q"] and row["synonyms"] == ["lives in"]
    assert {r["object"] for r in triples(after).collect()} == ({"O", "N"} if strict else {"N"})


def test_one_hop(spark):
    g = graph_of(spark, [("A", "e1", "B", "c"), ("B", "e2", "C", "c"), ("C", "e3", "D", "c")])
    facts = search.around(g, spark.createDataFrame([("B",)], "text string"))
    assert {(r["subject"], r["relation"], r["object"]) for r in facts.collect()} == {("A", "e1", "B"), ("B", "e2", "C")}
    lines = {r["triple"]: r["start_date"] for r in search.search_report(facts).collect()}
    assert lines == {"(A)-[e1]->(B)": "None", "(B)-[e2]->(C)": "None"}


# ---- retrieval ----


def test_topic_boost(spark):
    rows = spark.createDataFrame([("s", "r", "o", "newest", 3, 30), ("s", "r", "o", "oldest", 7, 10), ("s", "r", "o", "middle", 7, 20)], "subject string, relation string, object string, context_text string, community long, created_at long")
    assert [r["context_text"] for r in retrieve.boosted(rows, 7, 15).collect()] == ["middle", "oldest", "newest"]
    assert [r["context_text"] for r in retrieve.boosted(rows, retrieve.NO_TOPIC, 15).collect()] == ["newest", "middle", "oldest"]


def test_retrieve_and_reinforce(spark):
    g = graph_of(spark, [("A", "e1", "B", "c1"), ("A", "e1", "B", "c2"), ("X", "e9", "Y", "c9")])
    g = maintain.maintenance(g, NOW + DAY_MS, Params())
    got = retrieve.retrieve(g, [1.0, 0.0], ["A"], Params(search_threshold=1.1, top_nodes=3))
    assert [(r["subject"], r["relation"], r["object"], r["context_text"]) for r in got.collect()] == [("A", "e1", "B", "c1"), ("A", "e1", "B", "c2")]
    seen = maintain.reinforce(g.events, got, NOW + 9).orderBy("text").collect()
    assert [(r["text"], r["created_at"], r["last_accessed"]) for r in seen] == [("e1", NOW + 9, NOW + 9), ("e9", NOW, None)]
    report = retrieve.report(got.withColumn("community", F.lit(-1)).withColumn("is_current", F.lit(None).cast("boolean"))).collect()
    assert [(r["topic"], r["context_text"], r["facts"]) for r in report] == [("unclassified", c, "(A)-[e1]->(B) [past]") for c in ("c1", "c2")]


def test_seeds(spark):
    entities = spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0]), ("gammas", [-1.0, 0.0]), ("delta", None)], "text string, embedding array<double>")
    got = {r["text"] for r in retrieve.hybrid_seeds(entities, [1.0, 0.1], ["delta", "gamma"], Params()).collect()}
    assert got == {"alpha", "delta", "gammas"}


# ---- reasoning ----


def test_edge_costs(spark):
    rows = [("SOURCE", 1, 1, 0.8), ("SOURCE", 1, 2, 1.0), ("SIMILAR_TO", 1, 1, 8.0), ("SIMILAR_TO", 1, 2, 10.0), ("DERIVED_FROM", 1, 2, 5.0), ("DERIVED_FROM", 3, 3, 4.0), ("SOURCE", None, None, 1.0), ("TARGET", -1, -1, 1.0)]
    df = spark.createDataFrame(rows, "t string, a long, b long, want double")
    assert all(r[0] == pytest.approx(r[1]) for r in df.select(steiner.edge_cost(F.col("t"), F.col("a"), F.col("b"), Params()), "want").collect())


def test_steiner_is_a_short_tree():
    rng = random.Random(3)
    for _ in range(40):
        nodes = [f"n{i}" for i in range(7)]
        edges = [(a, b, float(rng.randint(1, 9))) for a, b in itertools.combinations(nodes, 2) if rng.random() < 0.5]
        ends = rng.sample(nodes, 3)
        tree = steiner.steiner_edges(edges, ends)
        best = math.inf
        for k in range(2, 7):  # the best tree spans some set of nodes that holds the terminals
            for others in itertools.combinations([n for n in nodes if n not in ends], k - 2):
                held = {*ends, *others}
                inside = steiner.spanning([(w, a, b) for a, b, w in edges if a in held and b in held])
                if len(inside) == len(held) - 1:
                    best = min(best, sum(w for w, _, _ in inside))
        cost = sum(w for _, _, w in tree)
        if best == math.inf:
            assert tree == []
        else:
            names = {n for a, b, _ in tree for n in (a, b)}
            assert set(ends) <= names and len(tree) == len(names) - 1 and best <= cost <= 2 * best
    assert steiner.steiner_edges([("a", "b", 1.0)], ["a", "a"]) == []


def test_answers(spark):
    g = graph_of(spark, [("A", "e1", "B", "c"), ("B", "e2", "C", "c"), ("X", "e9", "Y", "c")])
    assert reason.answer(g, ["A", "C"], Params.v2()).first()["answer"].endswith("path: e1 -- A, e1 -- B, e2 -- B, e2 -- C")
    assert reason.answer(g, ["A", "A"], Params.v2()).first()["answer"].startswith("no path; seeds: A; related: ")
    assert reason.answer(g, ["A", "X"], Params.v2()).first()["answer"].startswith("no path; seeds: A, X")


def test_parallel_edges_the_later_wins(spark):
    edges = spark.createDataFrame([("a", "b", "SOURCE", 1.0, 1), ("b", "a", "TARGET", 2.0, 2), ("a", "a", "SOURCE", 1.0, 1)], "src string, dst string, type string, cost double, place int")
    assert [tuple(r) for r in steiner.simple_edges(edges).collect()] == [("a", "b", "TARGET", 2.0)]


# ---- communities ----


def test_leiden(spark):
    rng = random.Random(7)
    cliques = [[f"{c}{i}" for i in range(6)] for c in "abcd"]
    edges = [(x, y, 1.0) for c in cliques for x, y in itertools.combinations(c, 2)] + [("a0", "b0", 1.0), ("b1", "c0", 1.0)]
    edges += [(f"z{i}", f"z{i + 1}", rng.random() + 0.5) for i in range(4)]
    df = both_ways(spark, edges)
    got = communities.leiden(df).collect()
    by = {}
    for r in got:
        by.setdefault(r["community"], set()).add(r["node"])
    assert {frozenset(c) for c in cliques} <= {frozenset(c) for c in by.values()}
    assert {r["node"] for r in got} == {n for e in edges for n in e[:2]}
    assert sorted(got) == sorted(communities.leiden(df).collect())
    parts = spark.createDataFrame([(r["node"], r["leader"]) for r in got], "node string, leader string")
    whole = communities.components(df).withColumnRenamed("component", "leader")
    alone = parts.select("node", F.col("node").alias("leader"))
    score = communities.modularity(df, parts)
    assert score > communities.modularity(df, whole) and score > communities.modularity(df, alone)
    spread = communities.leiden(df, task_edges=0)  # every component is moved by joins
    assert spread.count() == len(got)


def test_large_components_keep_modularity(spark):
    """Users, their events and the events' types, in one component: by joins as good as the kernel, nearly."""
    rng = random.Random(5)
    edges = []
    for i in range(120):
        group = i % 4
        edges += [(f"u{group}{rng.randrange(5)}", f"e{i}", 1.0), (f"e{i}", f"t{group if rng.random() < 0.9 else rng.randrange(4)}", 1.0)]
    df = both_ways(spark, edges)
    one, many = (communities.leiden(df, task_edges=n).select("node", "leader").collect() for n in (10**6, 0))
    assert {r["node"] for r in one} == {r["node"] for r in many} and len(one) == len(many)
    scores = [communities.modularity(df, spark.createDataFrame(x, "node string, leader string")) for x in (one, many)]
    print("kernel, joins:", scores)
    assert scores[1] > 0.9 * scores[0]
    assert all(r["leader"] <= r["node"] for r in many)


def test_background_cycle(spark):
    g = graph_of(spark, [("A", "e1", "B", "c"), ("C", "e2", "D", "c")])
    after = maintain.background(g, Params.v2(similar_threshold=0.9))
    assert {(r["src"], r["dst"]) for r in after.edges_similar.collect()} == {("A", "C"), ("B", "D")}
    again = maintain.densify(after, Params.v2(similar_threshold=0.9))
    assert again.edges_similar.count() == 2
    assert after.entities.filter("community_id is null").count() == 0


# ---- text ----


def test_extraction(spark):
    answer = '{"tool_name": "information", "kg_entity": [{"subject":"a","relation":"r","object":"b"}, {}, {"subject":"c","object":""}]}'
    df = spark.createDataFrame([(1, answer), (2, "no json"), (3, '{"tool_name":"other"}')], "id int, answer string")
    assert [(r["subject"], r["relation"], r["object"]) for r in extract.triples(df).collect()] == [("a", "r", "b")]
    assert {r["name"] for r in extract.entity_names(df, "id").collect()} == {"a", "b", "c"}
    assert [r["handler"] for r in extract.routed(df).orderBy("id").collect()] == ["information", "error", "other"]


def test_history(spark):
    turns = spark.createDataFrame([(1, i, "user", str(i)) for i in range(45)] + [(2, 0, "user", "x")], "session long, turn long, role string, text string")
    p = Params()
    assert history.last_turns(turns, "session", "turn", p.history_window).filter("session = 1").agg(F.min("turn")).first()[0] == 25
    new = spark.createDataFrame([(1, 45, "user", "q"), (1, 46, "model", "a")], turns.schema)
    after = history.append_turns(turns, new, "session", "turn", p.history_cap)
    assert {r["session"]: r["n"] for r in after.groupBy("session").agg(F.count("turn").alias("n")).collect()} == {1: 40, 2: 1}


def test_rendering(spark):
    df = spark.createDataFrame([("a\nb",), ("",)], "t string")
    assert [r[0] for r in df.select(text.sse_frame(F.col("t"))).collect()] == ["data: a\ndata: b\n\n", "data: \n\n"]
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = v.select(vector.cosine(F.col("a"), F.col("b")), vector.cosine(F.col("a"), F.col("b"), "normalized"), vector.unit(F.col("a"))).collect()
    assert got[0][0] == pytest.approx(0.96) and got[0][1] == pytest.approx(0.98) and got[0][2] == pytest.approx([0.6, 0.8])
    assert got[1][0] is None and got[1][2] == [0.0, 0.0]


def test_a_large_component_stays_in_one_task(spark, monkeypatch):
    """2.25 million edge rows of one component fit the kernel's arrays; they are not moved by joins."""
    monkeypatch.setattr(communities, "spread_communities", lambda *a: pytest.fail("moved by joins"))
    one = spark.range(1501).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("src"))
    df = one.join(one.withColumnRenamed("src", "dst")).filter("src <> dst").withColumn("w", F.lit(1.0))
    got = communities.leiden(df).collect()
    assert len(got) == 1501 and {r["leader"] for r in got} == {"n0"}


def test_dense_components_stay_in_one_task(spark, monkeypatch):
    """A component whose nodes have many neighbours may have three times the rows; beyond the bound by copies of its edges alone, a sparse one stays too."""
    monkeypatch.setattr(communities, "spread_communities", lambda *a: pytest.fail("moved by joins"))
    clique = [(f"c{i:02}", f"c{j:02}", 1.0) for i in range(70) for j in range(i)]
    assert {r["leader"] for r in communities.leiden(both_ways(spark, clique), task_edges=2000).collect()} == {"c00"}
    ring = [(f"r{i // 6}{i % 6}", f"r{i // 6}{j}", 0.5) for i in range(30) for j in range(i % 6)] + [(f"r{i}0", f"r{i + 1}1", 0.25) for i in range(4)]
    df = both_ways(spark, ring)
    twice = df.unionByName(df).repartition(4)
    got = {(r["node"], r["leader"]) for r in communities.leiden(twice, task_edges=2 * len(ring)).collect()}
    assert got == {(f"r{i}{j}", f"r{i}0") for i in range(5) for j in range(6)}


def test_packed_edges(spark):
    """Blocks of edges hold every edge once, by parts that are connected, with its weight."""
    df = both_ways(spark, [("a", "b", 1.0), ("b", "c", 2.5), ("x", "y", 1.0)]).coalesce(1)
    rows = {r["root"]: r for r in communities.packed(df.unionByName(df).coalesce(1)).collect()}
    assert {k: (r["names"], r["rows"], r["total"]) for k, r in rows.items()} == {"a": (["a", "b", "c"], 4, 14.0), "x": (["x", "y"], 2, 4.0)}
    names, a, b, w, sizes = communities.unpacked(pa.Table.from_batches(communities.packed(df).toArrow().to_batches()))
    ends = {(names[i].as_py(), names[j].as_py(), x) for i, j, x in zip(a.tolist(), b.tolist(), w.tolist(), strict=True)}
    assert ends == {tuple(r) for r in df.collect()} and sorted(sizes.tolist()) == [2, 4]


def test_a_component_beyond_one_task_shrinks_to_it(spark, monkeypatch):
    """Users, their events and the events' types in one component over the bound: events join users until the kernel can move the rest, not joins."""
    monkeypatch.setattr(communities, "spread_communities", lambda *a: pytest.fail("moved by joins"))
    rng = random.Random(11)
    edges = []
    for i in range(400):
        group = i % 4
        w = rng.choice([0.5, 1.0])
        edges += [(f"u{group}{rng.randrange(6)}", f"e{i}", w), (f"e{i}", f"t{group if rng.random() < 0.9 else rng.randrange(4)}", w)]
    df = both_ways(spark, edges).repartition(3)
    one, many = (communities.leiden(df, task_edges=n).select("node", "leader").collect() for n in (10**6, 800))
    assert {r["node"] for r in one} == {r["node"] for r in many} and len(one) == len(many)
    scores = [communities.modularity(df, spark.createDataFrame(x, "node string, leader string")) for x in (one, many)]
    assert scores[1] > 0.98 * scores[0]
    groups = {}
    for r in many:
        groups.setdefault(r["leader"], set()).add(r["node"])
    assert all(leader == min(g) for leader, g in groups.items())
