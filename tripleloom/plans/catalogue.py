"""One query for each operator, over whole tables, with the DuckDB SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract, text
from ..operators import agent, communities, fuzzy, history, ingest, maintain, nearest, pagerank, reason, resolve, retrieve, search, stages, steiner, vector_index
from ..schema import BATCH, Params
from ..sources import store
from ..sources.scratch import scratch
from ..sources.fixtures import NOW_MS, event_graph, name, order_graph, table, vector_graph, vector_of
from ..streaming.ingest import last_access

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

ORDERS = """
src AS (SELECT DISTINCT 'C' || o_custkey AS entity, 'O' || o_orderkey AS event FROM orders),
tgt AS (SELECT DISTINCT 'O' || l_orderkey AS event, 'P' || l_partkey AS entity FROM lineitem),
tri AS (SELECT s.entity AS subject, s.event, t.entity AS object FROM src s JOIN tgt t ON s.event = t.event)"""
COSINE = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---- joins and scans ----


@query(f"WITH {ORDERS} SELECT subject, event, object FROM tri")
def triple_view(spark, sf):
    return store.triples(order_graph(spark, sf))


@query("""WITH s AS (SELECT DISTINCT 'u' || user_id AS entity, event_type AS event FROM events),
t AS (SELECT DISTINCT event_type AS event, 'd' || day(ts) AS entity FROM events)
SELECT s.entity AS subject, s.event, t.entity AS object FROM s JOIN t ON s.event = t.event""")
def triple_cross_product(spark, sf):
    """Events keyed by their text alone: facts that share a relation combine."""
    e = table(spark, sf, "events")
    g = store.empty(spark).having(
        edges_source=e.select(name("u", "user_id").alias("entity"), F.col("event_type").alias("event")).distinct(),
        edges_target=e.select(F.col("event_type").alias("event"), F.concat(F.lit("d"), F.dayofmonth("ts").cast("string")).alias("entity")).distinct(),
    )
    return store.triples(g)


@query(f"""WITH {ORDERS}, docs AS (SELECT doc_id, md5(text) AS m FROM documents), n AS (SELECT count(*) AS n FROM documents),
der AS (SELECT 'O' || o_orderkey AS event, m FROM orders, n JOIN docs ON docs.doc_id = o_orderkey % n.n WHERE o_orderstatus <> 'F')
SELECT tri.event, object, coalesce(m, '') AS context_md5 FROM tri LEFT JOIN der ON tri.event = der.event""")
def provenance_left_join(spark, sf):
    """Facts with their source sentence, if any; open orders come from documents."""
    docs = table(spark, sf, "documents")
    n = docs.count()
    o = table(spark, sf, "orders").filter("o_orderstatus != 'F'").select(name("O", "o_orderkey").alias("event"), (F.col("o_orderkey") % n).alias("doc_id"))
    derived = o.join(docs.select("doc_id", F.md5("text").alias("context")), "doc_id").select("event", "context")
    t = store.triples(order_graph(spark, sf)).join(derived, "event", "left")
    return t.select("event", "object", F.coalesce("context", F.lit("")).alias("context_md5"))


@query(f"""WITH {ORDERS}, f AS (SELECT * FROM tri WHERE subject IN ('C1', 'C7') OR object IN ('P1', 'P2'))
SELECT DISTINCT subject, f.event AS relation, object, o.o_orderstatus <> 'F' AS is_current FROM f JOIN orders o ON 'O' || o.o_orderkey = f.event""")
def neighborhood_1hop(spark, sf):
    anchors = spark.createDataFrame([("C1",), ("C7",), ("P1",), ("P2",)], "text string")
    return search.around(order_graph(spark, sf), anchors).drop("start_date")


@query(f"""WITH {ORDERS} SELECT '(' || subject || ')-[' || f.event || ']->(' || object || ')' AS triple, o.o_orderstatus <> 'F' AS is_current, 'None' AS start_date
FROM tri f JOIN orders o ON 'O' || o.o_orderkey = f.event WHERE subject = 'C1' OR object = 'P1'""")
def search_report(spark, sf):
    anchors = spark.createDataFrame([("C1",), ("P1",)], "text string")
    return search.search_report(search.around(order_graph(spark, sf), anchors))


@query("""SELECT * FROM (SELECT 'Context' AS label, o_orderpriority AS text, NULL::BIGINT AS community_id FROM orders GROUP BY 2
UNION ALL SELECT 'Entity', 'C' || c_custkey, c_nationkey FROM customer UNION ALL SELECT 'Entity', 'P' || p_partkey, p_size FROM part
UNION ALL SELECT 'Event', 'O' || o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey) ORDER BY label, text LIMIT 100""")
def list_nodes(spark, sf):
    return store.list_nodes(order_graph(spark, sf), Params().list_limit).select("label", "text", "community_id")


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_keys(spark, sf):
    """The uniqueness constraint as a query: texts that several rows share."""
    d = table(spark, sf, "documents").select(F.md5("text").alias("text_md5"))
    return store.duplicates(d, ["text_md5"])


@query(f"""WITH {ORDERS}, e AS (SELECT entity FROM src UNION ALL SELECT entity FROM tgt) SELECT entity AS text, count(*) AS n FROM e GROUP BY entity""")
def degrees(spark, sf):
    return search.degrees(order_graph(spark, sf))


# ---- vectors ----


@query(f"""SELECT 'V' || b.vec_id AS text, round((1 + {COSINE}) / 2, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id = 0) a, embeddings b
WHERE (1 + {COSINE}) / 2 > 0.6 QUALIFY row_number() OVER (ORDER BY {COSINE} DESC, 'V' || b.vec_id) <= 5""")
def vector_topk(spark, sf):
    g = vector_graph(spark, sf)
    return nearest.top_k(g.entities, "text", vector_of(g, "V0"), 5, 0.6, strict=True).select("text", F.round("score", 6).alias("score"))


KNN = f"""k AS (SELECT 'V' || a.vec_id AS qkey, 'V' || b.vec_id AS ckey, {COSINE} AS score FROM embeddings a, embeddings b
QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, 'V' || b.vec_id) <= 10)"""


@query(f"WITH {KNN} SELECT qkey, ckey, round(score, 6) AS score FROM k")
def vector_knn10(spark, sf):
    e = vector_graph(spark, sf).entities
    near = nearest.nearest(e.select(F.col("text").alias("qkey"), "embedding"), e.select(F.col("text").alias("ckey"), "embedding"), 10, "raw")
    return near.select("qkey", "ckey", F.round("score", 6).alias("score"))


def _similar(spark, sf, threshold=0.35):
    return nearest.similar_pairs(vector_graph(spark, sf).entities, 10, threshold, 10.0, "raw")


@query(f"WITH {KNN} SELECT qkey AS src, ckey AS dst, round(score, 6) AS score, 10.0::DOUBLE AS cost FROM k WHERE score > 0.35 AND qkey < ckey")
def similar_edges(spark, sf):
    return _similar(spark, sf).withColumn("score", F.round("score", 6))


@query(f"""WITH {KNN}, e AS (SELECT qkey AS s, ckey AS d FROM k WHERE score > 0.35 AND qkey < ckey), b AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
{", ".join(f"c{i} AS MATERIALIZED (SELECT b.s, min(least(b.s, x.c)) AS c FROM b JOIN {'(SELECT DISTINCT s, s AS c FROM b)' if i == 0 else f'c{i - 1}'} x ON x.s = b.d GROUP BY b.s)" if i == 0 else f"c{i} AS MATERIALIZED (SELECT b.s, min(least(o.c, x.c)) AS c FROM b JOIN c{i - 1} x ON x.s = b.d JOIN c{i - 1} o ON o.s = b.s GROUP BY b.s)" for i in range(40))}
SELECT s AS node, c AS component FROM c39""")
def connected_components(spark, sf):
    e = _similar(spark, sf).select("src", "dst")
    return communities.components(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))


@query(f"""WITH nxt AS (SELECT vec_id - 1 AS vec_id, embedding AS n FROM embeddings),
m AS (SELECT e.vec_id, list_transform(list_zip(e.embedding::DOUBLE[], n::DOUBLE[]), lambda x: 0.8::DOUBLE * x[1] + 0.6::DOUBLE * x[2]) AS embedding FROM embeddings e JOIN nxt USING (vec_id)),
best AS (SELECT a.vec_id, 'V' || b.vec_id AS ckey, (1 + {COSINE}) / 2 AS score FROM m a, embeddings b QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, 'V' || b.vec_id) = 1)
SELECT 'm' || vec_id AS mention, CASE WHEN score >= 0.9 THEN ckey ELSE '#' || vec_id END AS resolved, CASE WHEN score >= 0.9 THEN 'vector' ELSE 'new' END AS how FROM best""")
def resolve_entities(spark, sf):
    """Blends of neighbouring vectors: most resolve by meaning, none by spelling (their names have no letters)."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("n"))
    mixed = v.join(after, "vec_id").select(name("m", "vec_id").alias("mention"), name("#", "vec_id").alias("text"), F.zip_with("embedding", "n", lambda a, b: 0.8 * a + 0.6 * b).alias("embedding"))
    stored = vector_graph(spark, sf).entities.withColumn("text", F.concat(F.col("text"), F.lit("")))
    return resolve.resolve(mixed, stored, Params.v2(spelling_threshold=1.1)).select("mention", "resolved", "how")


@query(f"""SELECT DISTINCT text FROM (SELECT 'V' || b.vec_id AS text FROM (SELECT * FROM embeddings WHERE vec_id = 3) a, embeddings b
WHERE (1 + {COSINE}) / 2 > 0.6 QUALIFY row_number() OVER (ORDER BY {COSINE} DESC, 'V' || b.vec_id) <= 5 UNION ALL SELECT 'V' || vec_id FROM embeddings WHERE vec_id = 7)""")
def hybrid_seeds(spark, sf):
    g = vector_graph(spark, sf)
    return retrieve.hybrid_seeds(g.entities, vector_of(g, "V3"), ["V7", "nobody"], Params())


@query(f"""WITH near AS (SELECT 'V' || b.vec_id AS text, b.vec_id, a.vec_id AS of_, (1 + {COSINE}) / 2 AS score FROM (SELECT * FROM embeddings WHERE vec_id IN (0, 1)) a, embeddings b
WHERE (1 + {COSINE}) / 2 >= 0.5 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, 'V' || b.vec_id) <= 3),
rel AS (SELECT a.vec_id, (1 + {COSINE}) / 2 AS e_score FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b)
SELECT s.text AS subject, 'E' || s.vec_id AS event, o.text AS object, round(s.score * o.score * e_score, 6) AS total FROM near s JOIN near o ON o.vec_id = s.vec_id + 1 AND s.of_ = 0 AND o.of_ = 1 JOIN rel ON rel.vec_id = s.vec_id""")
def path_scoring(spark, sf):
    g = vector_graph(spark, sf)
    p = Params()
    s, o = (nearest.top_k(g.entities, "text", vector_of(g, v), 3, 0.5).select("text", "score") for v in ("V0", "V1"))
    return search.score_paths(g, s, o, vector_of(g, "V0"), p).select("subject", "event", "object", F.round("total", 6).alias("total"))


@query("""WITH r AS (SELECT vec_id FROM embeddings WHERE vec_id < (SELECT max(vec_id) FROM embeddings))
SELECT 'E' || vec_id AS text, vec_id <> 0 AS is_current, CASE WHEN vec_id = 0 THEN 1709251200000 END AS ended, NULL::BIGINT AS started, '' AS queries FROM r
UNION ALL SELECT 'moved to', true, NULL, 1709251200000, 'they moved'""")
def scd2_expire_insert(spark, sf):
    """The fact V0 -E0-> V1 ends and a new one begins."""
    g = vector_graph(spark, sf)
    v0, v1 = vector_of(g, "V0"), vector_of(g, "V1")
    after = search.update(g, search.Change(v0, v1, "moved to", v0, "a new place", v1, "they moved"), NOW_MS, Params())
    return after.events.select("text", "is_current", F.unix_millis("end_date").alias("ended"), F.unix_millis("start_date").alias("started"), F.coalesce(F.array_join("source_queries", "|"), F.lit("")).alias("queries"))


# ---- time and weights ----

WEIGHT = "exp(-0.05::DOUBLE * ((1709251200000 - (epoch_us(ts) // 1000)) / 86400000.0::DOUBLE))"


@query(f"SELECT 'e' || event_id AS event, round({WEIGHT}, 6) AS weight FROM events")
def time_decay(spark, sf):
    e = event_graph(spark, sf).events
    return e.select(F.col("text").alias("event"), F.round(maintain.decayed(F.col("created_at"), NOW_MS, Params().decay), 6).alias("weight"))


@query(f"""SELECT 'u' || user_id AS a, 'e' || event_id AS b, round({WEIGHT}, 6) AS weight FROM events
UNION ALL SELECT 'e' || event_id, 't' || event_type, round({WEIGHT}, 6) FROM events""")
def edge_weight_refresh(spark, sf):
    g = maintain.refresh_weights(event_graph(spark, sf), NOW_MS, Params())
    s = g.edges_source.select(F.col("entity").alias("a"), F.col("event").alias("b"), F.round("weight", 6).alias("weight"))
    return s.unionByName(g.edges_target.select(F.col("event").alias("a"), F.col("entity").alias("b"), F.round("weight", 6).alias("weight")))


@query("""SELECT 'e' || event_id AS text, CASE WHEN user_id = 1 THEN 1709251200000 ELSE (epoch_us(ts) // 1000) END AS created_at,
CASE WHEN user_id = 1 THEN 1709251200000 END AS last_accessed FROM events""")
def reinforce(spark, sf):
    g = event_graph(spark, sf)
    hit = g.edges_source.filter("entity = 'u1'").select(F.col("event").alias("relation"))
    return maintain.reinforce(g.events, hit, NOW_MS).select("text", "created_at", "last_accessed")


# ---- ranking ----


def _rank_sql(weight: str, rounds: int = 20) -> str:
    steps = ", ".join(
        f"r{i} AS MATERIALIZED (SELECT node, sum(score) AS score FROM (SELECT dst AS node, 0.85::DOUBLE * sum(score * p) AS score FROM st JOIN r{i - 1} ON src = node GROUP BY dst UNION ALL SELECT node, score FROM r0) GROUP BY node)"
        for i in range(1, rounds + 1)
    )
    return f"""ev AS (SELECT 'N:u' || user_id AS u, 'E:e' || event_id AS e, 'N:t' || event_type AS t, {weight} AS w FROM events),
one AS (SELECT u AS src, e AS dst, w FROM ev UNION ALL SELECT t, e, w FROM ev), bo AS (SELECT src, dst, w FROM one UNION ALL SELECT dst, src, w FROM one),
su AS (SELECT src, dst, sum(w) AS w FROM bo GROUP BY src, dst), tot AS (SELECT src, sum(w) AS a FROM su GROUP BY src),
st AS MATERIALIZED (SELECT src, dst, w / a AS p FROM su JOIN tot USING (src)), r0 AS (SELECT 'N:u1' AS node, 1 - 0.85::DOUBLE AS score), {steps}"""


def _ranks(spark, sf, weighted: bool) -> DataFrame:
    g = event_graph(spark, sf)
    if weighted:
        g = maintain.refresh_weights(g, NOW_MS, Params())
    seeds = spark.createDataFrame([("N:u1",)], "node string")
    return pagerank.pagerank(maintain.projection(g, False, weighted), seeds)


@query(f"WITH {_rank_sql(WEIGHT)} SELECT node, round(score, 6) AS score FROM r20")
def ppr_weighted(spark, sf):
    return _ranks(spark, sf, True).select("node", F.round("score", 6).alias("score"))


@query(f"WITH {_rank_sql('1.0::DOUBLE')} SELECT node, round(score, 6) AS score FROM r20")
def ppr_unweighted(spark, sf):
    return _ranks(spark, sf, False).select("node", F.round("score", 6).alias("score"))


@query(f"WITH {_rank_sql(WEIGHT)} SELECT node, round(score, 9) AS score FROM r20 ORDER BY round(score, 9) DESC, node LIMIT 30")
def ppr_topk_nodes(spark, sf):
    ranks = _ranks(spark, sf, True).withColumn("score", F.round("score", 9))
    return retrieve.top_nodes(ranks, ranks, 30, 0.0)


@query(f"""WITH {_rank_sql(WEIGHT)}, top AS (SELECT node FROM r20 ORDER BY round(score, 9) DESC, node LIMIT 30)
SELECT substr(u, 3) AS subject, substr(e, 3) AS relation, substr(t, 3) AS object, '' AS context_text, user_id % 10 AS community, true AS is_current, (epoch_us(ts) // 1000) AS created_at
FROM ev JOIN events ON e = 'E:e' || event_id WHERE u IN (FROM top) OR e IN (FROM top) OR t IN (FROM top)
ORDER BY CASE WHEN user_id % 10 = 1 THEN 1 ELSE 0 END DESC, created_at DESC NULLS FIRST, subject, relation, object LIMIT 15""")
def retrieve_flagship(spark, sf):
    """Decay, then the whole retrieval from one user's name: seeds, dominant community, rank, 30 nodes, their facts, topic first, 15 rows."""
    g = maintain.refresh_weights(event_graph(spark, sf), NOW_MS, Params())
    return retrieve.retrieve(g, [0.0], ["u1"], Params.v1())


@query(f"""WITH {ORDERS} SELECT subject, t.event AS relation, object, o_orderpriority AS context_text, c_nationkey::BIGINT AS community, o_orderstatus <> 'F' AS is_current, (epoch_us(o_orderdate) // 1000) AS created_at
FROM tri t JOIN orders ON 'O' || o_orderkey = t.event JOIN customer ON c_custkey = o_custkey
ORDER BY CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END DESC, created_at DESC NULLS FIRST, subject, relation, object LIMIT 15""")
def topic_boost_top15(spark, sf):
    g = order_graph(spark, sf)
    every = g.events.select(F.concat(F.lit("E:"), "text").alias("node"))
    return retrieve.boosted(retrieve.facts_of(g, every), 7, 15)


@query(f"""WITH {ORDERS}, n AS (SELECT 'C' || c_custkey AS x FROM customer WHERE c_nationkey = 3 UNION SELECT 'O' || o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = 3)
SELECT entity AS src, event AS dst, 'SOURCE' AS type FROM src WHERE entity IN (FROM n) AND event IN (FROM n)""")
def induced_subgraph(spark, sf):
    """Edges inside one community of customers and orders."""
    g = order_graph(spark, sf)
    nodes = reason.labelled_nodes(g).filter("community_id = 3 and text not like 'P%'").select("node")
    edges = reason.induced(reason.typed_edges(g), nodes)
    return edges.select(F.substring("src", 3, 99).alias("src"), F.substring("dst", 3, 99).alias("dst"), "type")


@query("SELECT label::BIGINT AS community_id, count(*) AS n FROM embeddings GROUP BY label ORDER BY n DESC, label LIMIT 1")
def dominant_community(spark, sf):
    return retrieve.dominant_community(vector_graph(spark, sf).entities)


@query("SELECT label::BIGINT AS community_id, count(*) AS n FROM embeddings GROUP BY label")
def community_distribution(spark, sf):
    return vector_graph(spark, sf).entities.groupBy("community_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'u' || user_id AS text, min(user_id % 10) AS community FROM events GROUP BY user_id UNION ALL SELECT 't' || event_type, -1 FROM events GROUP BY event_type")
def seed_communities(spark, sf):
    g = event_graph(spark, sf)
    return retrieve.seed_communities(g.entities, g.entities)


COSTS = """c AS (SELECT 'C' || c_custkey AS x, c_nationkey AS k FROM customer UNION ALL SELECT 'P' || p_partkey, p_size FROM part UNION ALL SELECT 'O' || o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey)"""


@query(f"""WITH {ORDERS}, {COSTS}, e AS (SELECT entity AS a, event AS b, 'SOURCE' AS type FROM src UNION ALL SELECT event, entity, 'TARGET' FROM tgt)
SELECT a AS src, b AS dst, type, CASE WHEN coalesce(x.k, -1) = coalesce(y.k, -2) AND x.k IS NOT NULL THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS cost FROM e LEFT JOIN c x ON x.x = a LEFT JOIN c y ON y.x = b""")
def edge_cost_policy(spark, sf):
    g = order_graph(spark, sf)
    topics = reason.labelled_nodes(g).select("node", "community_id")
    e = reason.typed_edges(g)
    for side in ("src", "dst"):
        e = e.join(topics.select(F.col("node").alias(side), F.col("community_id").alias(f"c_{side}")), side, "left")
    cost = steiner.edge_cost(F.col("type"), F.col("c_src"), F.col("c_dst"), Params())
    return e.select(F.substring("src", 3, 99).alias("src"), F.substring("dst", 3, 99).alias("dst"), "type", cost.alias("cost"))


# ---- text ----

TYPOS = ["stell", "coper", "bras", "largge", "smal", "brished", "platedd", "tinn"]
TYPO_SQL = ", ".join(f"('{t}')" for t in TYPOS)


@query(f"""WITH q AS (SELECT * FROM (VALUES {TYPO_SQL}) v(query)), n AS (SELECT DISTINCT p_name AS entity FROM part),
t AS (SELECT entity, unnest(string_split(lower(entity), ' ')) AS token FROM n),
h AS (SELECT query AS qkey, entity, max(1 - levenshtein(query, token)::DOUBLE / greatest(length(query), length(token))) AS score FROM q, t WHERE levenshtein(query, token) <= 2 GROUP BY 1, 2)
SELECT qkey, entity, round(score, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY qkey ORDER BY score DESC, entity) <= 3""")
def fuzzy_match(spark, sf):
    names = table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    asked = spark.createDataFrame([(t, t) for t in TYPOS], "qkey string, text string")
    return fuzzy.fuzzy_hits(asked, names, 3).select("qkey", "entity", F.round("score", 6).alias("score"))


@query("SELECT DISTINCT p_name AS stored, round(2.0::DOUBLE * length(p_name) / (2 * length(p_name) + 1), 6) AS longer, round(2.0::DOUBLE * (length(p_name) - 1) / (2 * length(p_name) - 1), 6) AS shorter FROM part")
def sequence_ratio(spark, sf):
    """Matching-blocks ratio of each part name with itself and a letter more, and without its first letter."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("stored")).distinct()
    p = F.col("stored")
    return names.select("stored", F.round(text.sequence_ratio(F.concat(p, F.lit("~")), p), 6).alias("longer"), F.round(text.sequence_ratio(F.expr("substr(stored, 2)"), p), 6).alias("shorter"))


@query(r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+')) AS token FROM documents) WHERE token <> '' GROUP BY token""")
def keyword_tokens(spark, sf):
    k = extract.keywords(table(spark, sf, "documents"), "doc_id", "text")
    return k.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


@query(r"""SELECT conv_id, turn, array_to_string(list_transform(string_split(text, chr(10)), lambda x: 'data: ' || x || chr(10)), '') || chr(10) AS frame FROM conversations""")
def sse_format(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", text.sse_frame(F.col("text")).alias("frame"))


def _answers(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    some = F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment"))
    item = F.struct(F.col("c_name").alias("subject"), F.lit("buys for").alias("relation"), some.alias("object"))
    more = F.struct(F.lit(None).cast("string").alias("subject"), F.lit(None).cast("string").alias("relation"), F.lit(None).cast("string").alias("object"))
    tool = F.when(F.col("c_acctbal") >= 0, "information").when(F.col("c_acctbal") > -500, "other").otherwise("unknown")
    return c.select("c_custkey", F.to_json(F.struct(tool.alias("tool_name"), F.array(item, more).alias("kg_entity"))).alias("answer"))


@query("SELECT c_custkey, 0 AS place, c_name AS subject, 'buys for' AS relation, c_mktsegment AS object FROM customer WHERE c_acctbal >= 0")
def extract_triples_json(spark, sf):
    return extract.triples(_answers(spark, sf))


@query("SELECT c_custkey, c_name AS name FROM customer UNION SELECT c_custkey, c_mktsegment FROM customer WHERE c_acctbal >= 0")
def extract_entity_names(spark, sf):
    return extract.entity_names(_answers(spark, sf), "c_custkey")


@query("SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN 'information' WHEN c_acctbal > -500 THEN 'other' ELSE 'error' END AS handler FROM customer")
def route_answers(spark, sf):
    return extract.routed(_answers(spark, sf)).select("c_custkey", "handler")


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3")
def history_window(spark, sf):
    return history.last_turns(table(spark, sf, "conversations"), "conv_id", "turn", 3).select("conv_id", "turn", "role", "text")


@query("""WITH l AS (SELECT * FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3)
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS window_text FROM l GROUP BY conv_id""")
def prompt_window(spark, sf):
    return history.prompt_window(table(spark, sf, "conversations"), "conv_id", "turn", "role", "text", 3).withColumnRenamed("window", "window_text")


@query(f"""WITH {ORDERS}, top AS (SELECT c_nationkey::BIGINT AS community, o_orderpriority AS context_text, o_orderstatus <> 'F' AS now_, subject, t.event AS relation, object
FROM tri t JOIN orders ON 'O' || o_orderkey = t.event JOIN customer ON c_custkey = o_custkey
ORDER BY CASE WHEN c_nationkey = 7 THEN 1 ELSE 0 END DESC, (epoch_us(o_orderdate) // 1000) DESC NULLS FIRST, subject, relation, object LIMIT 15),
l AS (SELECT *, '(' || subject || ')-[' || relation || ']->(' || object || ')' || CASE WHEN now_ THEN '' ELSE ' [past]' END AS line FROM top)
SELECT community, 'topic ' || community AS topic, context_text, string_agg(line, chr(10) ORDER BY line) AS facts FROM l GROUP BY community, context_text""")
def retrieval_report(spark, sf):
    """The 15 rows that a retrieval returns, as text by community and context."""
    g = order_graph(spark, sf)
    every = g.events.select(F.concat(F.lit("E:"), "text").alias("node"))
    return retrieve.report(retrieve.boosted(retrieve.facts_of(g, every), 7, Params().top_rows))


# ---- writes ----


def _batch(spark, sf) -> DataFrame:
    e = table(spark, sf, "events")
    part = lambda t, o, v: F.struct(t.alias("text"), o.alias("original"), F.array(v).alias("embedding"))
    user, kind = name("u", "user_id"), name("t", "event_type")
    context = F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("veracity"), F.lit(None).cast("string").alias("date"))
    rows = e.select(F.col("event_id").alias("seq"), part(user, F.concat_ws("-", user, "event_type"), F.col("value")).alias("subject"), F.struct(F.col("event_type").alias("text"), F.array("value").alias("embedding")).alias("relation"), part(kind, kind, F.col("value")).alias("object"), context.alias("context"))
    return spark.createDataFrame([], BATCH).unionByName(rows)


def _upserted(spark, sf, params) -> DataFrame:
    old = table(spark, sf, "events").filter("user_id <= 7").select(name("u", "user_id").alias("text")).distinct().select("text", F.array(F.lit(0.0)).alias("embedding"), F.lit(1).cast("bigint").alias("created_at"), F.array().cast("array<string>").alias("synonyms"), F.lit(None).cast("bigint").alias("community_id"))
    new = ingest.upsert_entities(old, _batch(spark, sf), NOW_MS, params)
    return new.select("text", F.col("embedding")[0].alias("value"), "created_at", F.array_join("synonyms", "|").alias("synonyms"))


def _upsert_sql(last: bool) -> str:
    value = "arg_max(value, o)" if last else "CASE WHEN old THEN 0.0::DOUBLE ELSE arg_min(value, o) END"
    skip = "" if last else " AND (old OR o <> first_)"
    return f"""WITH m AS (SELECT 'u' || user_id AS text, 'u' || user_id || '-' || event_type AS original, value, event_id AS o FROM events
UNION ALL SELECT 't' || event_type, 't' || event_type, value, 1000000000000 + event_id FROM events),
k AS (SELECT *, text IN (SELECT 'u' || user_id FROM events WHERE user_id <= 7) AS old, min(o) OVER (PARTITION BY text) AS first_ FROM m),
v AS (SELECT text, old, {value} AS value FROM k GROUP BY text, old),
s AS (SELECT text, original, min(o) AS o FROM k WHERE original <> text{skip} GROUP BY text, original),
j AS (SELECT text, string_agg(original, '|' ORDER BY o) AS synonyms FROM s GROUP BY text)
SELECT v.text, value, CASE WHEN old THEN 1 ELSE 1709251200000 END AS created_at, coalesce(synonyms, '') AS synonyms FROM v LEFT JOIN j ON v.text = j.text"""


@query(_upsert_sql(True))
def upsert_entities_v1(spark, sf):
    return _upserted(spark, sf, Params.v1())


@query(_upsert_sql(False))
def upsert_entities_v2(spark, sf):
    return _upserted(spark, sf, Params.v2())


@query("SELECT event_type AS text, arg_max(value, event_id) AS value, true AS is_current, count(*) AS n FROM events GROUP BY event_type")
def upsert_events(spark, sf):
    """Events keyed by relation text, with the number of batch rows of each."""
    b = _batch(spark, sf)
    new = ingest.upsert_events(store.empty(spark).events, b, NOW_MS, Params())
    return new.select("text", F.col("embedding")[0].alias("value"), "is_current").join(b.groupBy(F.col("relation.text").alias("text")).agg(F.count(F.lit(1)).alias("n")), "text")


@query("""SELECT DISTINCT 'u' || user_id AS entity, event_type AS event, CASE WHEN user_id <= 7 THEN 0.5::DOUBLE END AS weight FROM events""")
def edge_merge(spark, sf):
    """Set union of edges; those that exist keep their weight."""
    e = table(spark, sf, "events").select("user_id", name("u", "user_id").alias("entity"), F.col("event_type").alias("event"))
    old = e.filter("user_id <= 7").select("entity", "event", F.lit(0.5).alias("weight")).distinct()
    return ingest.merge_edges(old, e.select("entity", "event", F.lit(None).cast("double").alias("weight")), ["entity", "event"])


@query("SELECT md5(text) AS text_md5, arg_min(source, doc_id) AS source, arg_min(lang, doc_id) AS veracity, count(*) AS n FROM documents GROUP BY text")
def context_dedup(spark, sf):
    """One context for each sentence, with the attributes of its first row, and how often it was said."""
    d = table(spark, sf, "documents")
    batch = d.select(F.col("doc_id").alias("seq"), F.struct("text", "source", F.col("lang").alias("veracity"), F.lit(None).cast("string").alias("date")).alias("context"))
    new = ingest.upsert_contexts(store.empty(spark).contexts, batch, NOW_MS)
    n = d.groupBy("text").agg(F.count(F.lit(1)).alias("n"))
    return new.join(n, "text").select(F.md5("text").alias("text_md5"), "source", "veracity", "n")


@query("""SELECT o_custkey, string_agg(o_orderpriority, '|' ORDER BY o) AS priorities FROM (SELECT o_custkey, o_orderpriority, min(o_orderkey) AS o FROM orders GROUP BY 1, 2) GROUP BY o_custkey""")
def synonym_append(spark, sf):
    """Ordered append of what is new, for each customer."""
    o = table(spark, sf, "orders").select(F.col("o_custkey").cast("string").alias("text"), F.col("o_orderpriority").alias("original"), F.struct(F.lit(0).cast("bigint").alias("a"), F.col("o_orderkey").alias("b")).alias("ord"))
    return ingest.ordered_new(o).select(F.col("text").cast("bigint").alias("o_custkey"), F.array_join("fresh", "|").alias("priorities"))


@query(f"""WITH {ORDERS}, gone AS (SELECT 'O' || o_orderkey AS event FROM orders WHERE o_orderstatus = 'F'),
e AS (SELECT entity, event FROM src UNION ALL SELECT entity, event FROM tgt),
had AS (SELECT DISTINCT entity FROM e WHERE event IN (FROM gone)), has AS (SELECT DISTINCT entity FROM e WHERE event NOT IN (FROM gone))
SELECT text FROM (SELECT 'C' || c_custkey AS text FROM customer UNION ALL SELECT 'P' || p_partkey FROM part) WHERE text NOT IN (SELECT entity FROM had WHERE entity NOT IN (FROM has))""")
def delete_event_orphans(spark, sf):
    """Entities left after all finished orders are deleted."""
    g = order_graph(spark, sf)
    return search.delete_events(g, g.events.filter("not is_current").select("text")).entities.select("text")


# ---- single operators ----


@query("""SELECT 'Entity' AS label, 'C' || c_custkey AS text, c_nationkey::BIGINT AS community_id FROM customer WHERE c_custkey IN (1, 3, 7)
UNION ALL SELECT 'Event', 'O' || o_orderkey, c_nationkey FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderkey IN (1, 2)""")
def lookup_nodes(spark, sf):
    """Nodes by id; those that are not there give no row."""
    asked = [("Entity", "C1"), ("Entity", "C3"), ("Entity", "C7"), ("Event", "O1"), ("Event", "O2"), ("Event", "C1"), ("Context", "none")]
    return store.lookup(order_graph(spark, sf), asked).select("label", "text", "community_id")


@query("""SELECT * FROM (VALUES ('contexts', 'text'), ('edges_derived', 'event'), ('edges_derived', 'context'), ('edges_similar', 'src'), ('edges_similar', 'dst'), ('edges_source', 'entity'), ('edges_source', 'event'),
('edges_target', 'event'), ('edges_target', 'entity'), ('entities', 'text'), ('events', 'text')) v(frame, key_column)""")
def catalog_keys(spark, sf):
    return store.catalog(order_graph(spark, sf)).filter("is_key").select("frame", F.col("column").alias("key_column"))


def _saved(spark, sf) -> store.Store:
    s = store.Store(spark, scratch(spark, "store"))
    s.commit(order_graph(spark, sf), check=True)
    return s


HELD = """SELECT 'entities' AS frame, (SELECT count(*) FROM customer) + (SELECT count(*) FROM part) AS rows UNION ALL SELECT 'events', count(*) FROM orders UNION ALL SELECT 'contexts', count(DISTINCT o_orderpriority) FROM orders
UNION ALL SELECT 'edges_source', count(*) FROM orders UNION ALL SELECT 'edges_target', count(*) FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) UNION ALL SELECT 'edges_derived', count(*) FROM orders UNION ALL SELECT 'edges_similar', 0"""


@query(f"SELECT frame, 1::BIGINT AS version, rows::BIGINT AS rows FROM ({HELD})")
def store_health(spark, sf):
    """Commit with the key check, then read every frame."""
    return _saved(spark, sf).health()


@query("SELECT frame, 2::BIGINT AS version, 0::BIGINT AS rows FROM (VALUES ('entities'), ('events'), ('contexts'), ('edges_source'), ('edges_target'), ('edges_derived'), ('edges_similar')) v(frame)")
def store_clear(spark, sf):
    s = _saved(spark, sf)
    s.clear()
    s.prune(1)
    return s.health()


@query("SELECT n_name || 'X' AS mention, n_name AS resolved, 'spelling' AS how FROM nation UNION ALL SELECT 'Y', 'Y', 'new' UNION ALL SELECT 'ZZZZZZZZZZ', 'ZZZZZZZZZZ', 'new'")
def resolve_spelling(spark, sf):
    """Names with a letter more resolve by spelling; too short or too far ones are new."""
    n = table(spark, sf, "nation")
    held = n.select(F.col("n_name").alias("text"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    said = n.select(F.concat("n_name", F.lit("X")).alias("mention")).unionByName(spark.createDataFrame([("Y",), ("ZZZZZZZZZZ",)], "mention string"))
    asked = said.select("mention", F.col("mention").alias("text"), F.array(F.lit(-1.0), F.lit(0.0)).alias("embedding"))
    return resolve.resolve(asked, held, Params.v1()).select("mention", "resolved", "how")


@query(f"""SELECT 'E' || b.vec_id AS text, round((1 + {COSINE}) / 2, 6) AS score FROM (SELECT * FROM embeddings WHERE vec_id = 5) a, (SELECT * FROM embeddings WHERE vec_id < (SELECT max(vec_id) FROM embeddings)) b
WHERE (1 + {COSINE}) / 2 >= 0.5 QUALIFY row_number() OVER (ORDER BY {COSINE} DESC, 'E' || b.vec_id) <= 3""")
def event_candidates(spark, sf):
    """The nearest events to a vector, at or over a threshold."""
    g = vector_graph(spark, sf)
    return nearest.top_k(g.events, "text", vector_of(g, "V5"), 3, 0.5).select("text", F.round("score", 6).alias("score"))


@query(f"""WITH m AS (SELECT a.vec_id, b.vec_id AS b, {COSINE} AS score FROM embeddings a, embeddings b WHERE a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, 'V' || b.vec_id) = 1)
SELECT 'V' || vec_id AS qkey, 'V' || b AS ckey, round(score, 6) AS score FROM m""")
def nearest_other(spark, sf):
    """The one nearest other vector of each vector."""
    e = vector_graph(spark, sf).entities
    near = nearest.nearest(e.select(F.col("text").alias("qkey"), "embedding"), e.select(F.col("text").alias("ckey"), "embedding"), 2, "raw").filter("qkey != ckey")
    best = near.groupBy("qkey").agg(F.min_by(F.struct("ckey", "score"), F.struct(-F.col("score"), F.col("ckey"))).alias("b"))
    return best.select("qkey", "b.ckey", F.round("b.score", 6).alias("score"))


@query("SELECT count(*) AS n, true AS reached FROM embeddings")
def vector_index_recall(spark, sf):
    """Every vector is in the index, and with probes fitted on other rows at least 0.9 of the 10 nearest of every hundredth vector are found."""
    e = vector_graph(spark, sf).entities
    index = vector_index.build(e, "text", scratch(spark, "vectors"))
    asked = e.filter(F.expr("cast(substr(text, 2) as bigint) % 100 = 0")).select(F.col("text").alias("qkey"), "embedding")
    exact = nearest.nearest(asked, e.select(F.col("text").alias("ckey"), "embedding"), 10, "raw").select("qkey", "ckey", F.lit(1).alias("exact"))
    found = vector_index.nearest(asked, index, 10, vector_index.probes_for(index, 10), "raw").select("qkey", "ckey", F.lit(1).alias("found"))
    recall = exact.join(found, ["qkey", "ckey"], "left").agg((F.sum(F.coalesce("found", F.lit(0))) / F.count("exact")).alias("recall"))
    return index.rows().agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(recall), F.lit(True)).select("n", (F.col("recall") >= 0.9).alias("reached"))


@query(f"""WITH q AS (SELECT * FROM (VALUES {TYPO_SQL}) v(query)), n AS (SELECT DISTINCT p_name AS entity FROM part),
t AS (SELECT entity, unnest(string_split(lower(entity), ' ')) AS token FROM n),
h AS (SELECT query AS qkey, entity, max(1 - levenshtein(query, token)::DOUBLE / greatest(length(query), length(token))) AS score FROM q, t WHERE levenshtein(query, token) <= 2 GROUP BY 1, 2)
SELECT qkey, entity, round(score, 6) AS score FROM h QUALIFY row_number() OVER (PARTITION BY qkey ORDER BY score DESC, entity) <= 3""")
def text_index_match(spark, sf):
    """The same through a persisted full-text index."""
    names = table(spark, sf, "part").select(F.col("p_name").alias("text")).distinct()
    index = fuzzy.build_index(names, scratch(spark, "texts"))
    asked = spark.createDataFrame([(t, t) for t in TYPOS], "qkey string, text string")
    return fuzzy.fuzzy_hits(asked, index, 3).select("qkey", "entity", F.round("score", 6).alias("score"))


@query("""SELECT 'V5' AS subject, 'E5' AS relation, 'V6' AS object, true AS is_current UNION ALL SELECT 'V4', 'E4', 'V5', true""")
def search_nearest(spark, sf):
    """What is known around the entity nearest to a vector."""
    g = vector_graph(spark, sf)
    return search.search(g, vector_of(g, "V5"), Params.v1()).drop("start_date")


@query(f"""WITH {ORDERS}, l AS (SELECT subject, object, '(' || subject || ')-[' || event || ']->(' || object || ')' AS line FROM tri), a AS (SELECT * FROM (VALUES ('C1'), ('C2'), ('P1')) v(text)),
e AS (SELECT text FROM a WHERE text IN (SELECT 'C' || c_custkey FROM customer UNION ALL SELECT 'P' || p_partkey FROM part))
SELECT text, coalesce((SELECT string_agg(DISTINCT line, '|' ORDER BY line) FROM l WHERE subject = text), '') AS outgoing, coalesce((SELECT string_agg(DISTINCT line, '|' ORDER BY line) FROM l WHERE object = text), '') AS incoming FROM e""")
def knowledge_lists(spark, sf):
    """Facts of each entity as lists, as subject and as object."""
    anchors = spark.createDataFrame([("C1",), ("C2",), ("P1",)], "text string")
    k = search.knowledge(order_graph(spark, sf), anchors)
    return k.select("text", F.array_join("outgoing", "|").alias("outgoing"), F.array_join("incoming", "|").alias("incoming"))


@query(f"""WITH near AS (SELECT 'V' || b.vec_id AS text, b.vec_id, a.vec_id AS of_, (1 + {COSINE}) / 2 AS score FROM (SELECT * FROM embeddings WHERE vec_id IN (0, 1)) a, embeddings b
WHERE (1 + {COSINE}) / 2 >= 0.5 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, 'V' || b.vec_id) <= 30),
rel AS (SELECT a.vec_id, (1 + {COSINE}) / 2 AS e_score FROM embeddings a, (SELECT * FROM embeddings WHERE vec_id = 0) b)
SELECT s.text AS subject, 'E' || s.vec_id AS event, o.text AS object, round(s.score * o.score * e_score, 6) AS total FROM near s JOIN near o ON o.vec_id = s.vec_id + 1 AND s.of_ = 0 AND o.of_ = 1 JOIN rel ON rel.vec_id = s.vec_id
ORDER BY s.score * o.score * e_score DESC, subject, event, object LIMIT 1""")
def best_path(spark, sf):
    g = vector_graph(spark, sf)
    s, o = (nearest.top_k(g.entities, "text", vector_of(g, v), 30, 0.5).select("text", "score") for v in ("V0", "V1"))
    return search.best_path(search.score_paths(g, s, o, vector_of(g, "V0"), Params())).select("subject", "event", "object", F.round("total", 6).alias("total"))


@query(f"""WITH {KNN}, e AS (SELECT qkey AS src, ckey AS dst, score FROM k WHERE score > 0.35 AND qkey < ckey)
SELECT src, dst, CASE WHEN src = 'V0' THEN 0.5::DOUBLE ELSE round(score, 6) END AS score FROM e UNION SELECT 'V0', 'V1', 0.5""")
def densify_edges(spark, sf):
    """Edges between similar entities are added; those that exist keep their score."""
    g = vector_graph(spark, sf)
    new = _similar(spark, sf)
    old = new.filter("src = 'V0'").unionByName(spark.createDataFrame([("V0", "V1", 0.0, 10.0)], "src string, dst string, score double, cost double")).dropDuplicates(["src", "dst"]).withColumn("score", F.lit(0.5))
    after = maintain.densify(g.having(edges_similar=old), Params.v2(similar_threshold=0.35, score_mode="raw"))
    return after.edges_similar.select("src", "dst", F.round("score", 6).alias("score"))


@query(f"""WITH {ORDERS}, {COSTS}, e AS (SELECT 'N:' || entity AS x, 'E:' || event AS y, 'SOURCE' AS type, entity AS a, event AS b FROM src UNION ALL SELECT 'E:' || event, 'N:' || entity, 'TARGET', event, entity FROM tgt)
SELECT least(x, y) AS a, greatest(x, y) AS b, type, CASE WHEN p.k = q.k THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END AS cost FROM e LEFT JOIN c p ON p.x = e.a LEFT JOIN c q ON q.x = e.b""".replace("least(x, y)", "least(e.x, e.y)").replace("greatest(x, y)", "greatest(e.x, e.y)"))
def cost_graph(spark, sf):
    """The simple undirected graph that reasoning searches: one edge for each pair, with its cost."""
    g = order_graph(spark, sf)
    return reason.costed(reason.labelled_nodes(g), reason.typed_edges(g), Params.v2())


def _chain(spark, sf) -> store.Graph:
    """Nations in a row: N(i) -SOURCE-> R(i) -TARGET-> N(i + 1), and customers apart."""
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"))
    last = n.agg(F.max("k")).first()[0]
    row = n.filter(F.col("k") < last)
    people = table(spark, sf, "customer").select(name("C", "c_custkey").alias("text"), F.lit(None).cast("bigint").alias("community_id"))
    return store.empty(spark).having(
        entities=store.conform(n.select(name("N", "k").alias("text"), F.lit(1).cast("bigint").alias("community_id")).unionByName(people), "entities"),
        events=store.conform(row.select(name("R", "k").alias("text"), F.lit(NOW_MS).alias("created_at"), F.lit(True).alias("is_current"), F.lit(1).cast("bigint").alias("community_id")), "events"),
        edges_source=store.conform(row.select(name("N", "k").alias("entity"), name("R", "k").alias("event")), "edges_source"),
        edges_target=store.conform(row.select(name("R", "k").alias("event"), F.expr("concat('N', k + 1)").alias("entity")), "edges_target"),
    )


@query("""WITH e AS (SELECT 'N:N' || n_nationkey AS x, 'E:R' || n_nationkey AS y, n_nationkey AS k FROM nation UNION ALL SELECT 'N:N' || (n_nationkey + 1), 'E:R' || n_nationkey, n_nationkey FROM nation)
SELECT least(x, y) AS a, greatest(x, y) AS b FROM e WHERE k BETWEEN 2 AND 6""")
def steiner_chain(spark, sf):
    """The tree between three nations of a chain is the part of the chain between the outer two."""
    seeds = ["N2", "N5", "N7"]
    nodes, edges = reason.subgraph(_chain(spark, sf), seeds, Params.v2())
    tree = steiner.steiner_tree(reason.costed(nodes, edges, Params.v2()), nodes.filter(F.col("text").isin(seeds)).select("node"))
    return tree.select("a", "b")


@query("""WITH n AS (SELECT DISTINCT 'E:R' || n_nationkey AS node FROM nation WHERE n_nationkey IN (0, 1) UNION ALL SELECT 'N:N' || n_nationkey FROM nation WHERE n_nationkey <= 2)
SELECT node, true AS reached FROM n UNION ALL (SELECT 'N:C' || c_custkey, false FROM customer ORDER BY 1 LIMIT 25)""")
def padded_top_nodes(spark, sf):
    """Without a least score, nodes that rank did not reach fill the list of 30, by name."""
    g = _chain(spark, sf)
    g = g.having(edges_source=g.edges_source.filter("event in ('R0', 'R1')"), edges_target=g.edges_target.filter("event in ('R0', 'R1')"))
    nodes = reason.labelled_nodes(g).filter("label = 'Entity' and text like 'C%' or text in ('N0', 'N1', 'N2', 'R0', 'R1')")
    ranks = pagerank.pagerank(maintain.projection(g, False, False), spark.createDataFrame([("N:N0",)], "node string"))
    return retrieve.top_nodes(ranks, nodes, Params().top_nodes, None).select("node", (F.col("score") > 0).alias("reached"))


@query("""WITH p AS (SELECT 'N:S' || least(a.s_suppkey, b.s_suppkey) AS x FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey),
m AS (SELECT DISTINCT 'N:S' || a.s_suppkey AS node, a.s_nationkey AS n FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey <> b.s_suppkey)
SELECT node, min(node) OVER (PARTITION BY n) AS leader FROM m""")
def leiden_cliques(spark, sf):
    """Suppliers of a nation all know each other: each nation is one community, named by its smallest member."""
    s = table(spark, sf, "supplier").select(name("N:S", "s_suppkey").alias("x"), "s_nationkey")
    pairs = s.groupBy("s_nationkey").count().agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0
    s = s.repartitionByRange(1 + pairs // communities.BLOCK_EDGES, "s_nationkey", "x")  # a few suppliers have many pairs
    e = s.join(s.withColumnRenamed("x", "y"), "s_nationkey").filter("x != y").select(F.col("x").alias("src"), F.col("y").alias("dst"), F.lit(1.0).alias("w"))
    return communities.leiden(e).select("node", "leader")


@query("""WITH top AS (SELECT p_name AS text, p_size::DOUBLE AS score, p_partkey FROM part ORDER BY p_size DESC, 'N:P' || p_partkey LIMIT 10)
SELECT 'no path; seeds: P1, P2; related: ' || string_agg('P' || p_partkey, ', ' ORDER BY score DESC, 'N:P' || p_partkey) AS answer FROM top""")
def fallback_answer(spark, sf):
    """The line for seeds that no path joins: those that exist, and the ten best nodes."""
    n = table(spark, sf, "part").select(name("N:P", "p_partkey").alias("node"), F.lit("Entity").alias("label"), name("P", "p_partkey").alias("text"), F.col("p_size").cast("double").alias("score"))
    return reason.fallback(n, ["P2", "P1", "nobody"], Params.v2().fallback)


@query("""WITH best AS (SELECT p_size AS c FROM part GROUP BY p_size ORDER BY count(*) DESC, p_size LIMIT 1)
SELECT 'P' || p_partkey AS text, round(p_retailprice, 4) AS score FROM part, best WHERE p_size = c ORDER BY p_retailprice DESC, 'N:P' || p_partkey LIMIT 5""")
def topic_keywords(spark, sf):
    """The five best nodes of the dominant community."""
    n = table(spark, sf, "part").select(name("N:P", "p_partkey").alias("node"), name("P", "p_partkey").alias("text"), F.col("p_size").cast("bigint").alias("community_id"), F.col("p_retailprice").alias("score"))
    return reason.keywords(n, Params.v2().keywords).select("text", F.round("score", 4).alias("score"))


@query("SELECT event_type AS event, max(ts) AS last_accessed FROM events GROUP BY event_type")
def last_access_of_events(spark, sf):
    """The same plan that the stream runs, over a table."""
    return last_access(table(spark, sf, "events").select(F.col("event_type").alias("event"), F.col("ts").cast("timestamp").alias("at"))).withColumn("last_accessed", F.col("last_accessed").cast("timestamp_ntz"))


@query("SELECT * FROM (VALUES ('facts', 0), ('history', 0), ('seeds', 0), ('upserted', 0)) v(input, rows)")
def empty_inputs(spark, sf):
    """No seed, no batch row, no turn: nothing comes out, and nothing stops."""
    g, none = event_graph(spark, sf), store.empty(spark)
    turns = table(spark, sf, "conversations").limit(0)
    batch = _batch(spark, sf).limit(0)
    counts = {
        "facts": retrieve.retrieve(g.having(entities=g.entities.limit(0)), [0.0], [], Params.v2()).count(),
        "history": history.append_turns(turns, turns, "conv_id", "turn", 40).count(),
        "seeds": retrieve.hybrid_seeds(none.entities, [0.0], ["a name"], Params()).count(),
        "upserted": ingest.upsert(none, resolve.resolve_batch(batch, none.entities, Params()), NOW_MS, Params()).entities.count(),
    }
    return spark.createDataFrame(list(counts.items()), "input string, rows int")


def _models() -> agent.Models:
    """Stand-ins: an utterance is its own answer, and all vectors are null but for names of one letter."""
    return agent.Models(answer=lambda t: t, embed=lambda t: F.when(F.length(t) == 1, F.array(F.lit(1.0), F.ascii(t).cast("double"))))


@query("""SELECT * FROM (VALUES (0, 'information', 'noted: 2 facts', 2, 2), (1, 'error', 'the request was not understood', 2, 2), (2, 'other', '[topic]', 2, 3), (3, 'information', 'noted: 0 facts', 2, 5)) v(place, handler, reply, events, turns)""")
def chat_turns(spark, sf):
    """Four utterances through the handlers: facts are written, junk is refused, a question is answered with its facts."""
    item = '{"subject": "%s", "relation": "%s", "object": "%s"}'
    said = [
        '{"tool_name": "information", "kg_entity": [' + item % ("Ann Lee", "works at", "Acme") + ", " + item % ("Acme", "lies in", "Oslo") + "]}",
        "no json",
        '{"tool_name": "other", "kg_entity": [{"subject": "Ann Lee", "object": ""}]}',
        '{"tool_name": "information", "kg_entity": []}',
    ]
    it, g, past, rows = agent.Agent(_models()), store.empty(spark), spark.createDataFrame([], agent.HISTORY), []
    for i, text_ in enumerate(said):
        t = it.handle(g, past, "s", text_, NOW_MS + i)
        g, past = t.graph, t.history
        reply = "[topic]" if t.handler == "other" and t.reply.startswith("[topic ") and "(Ann Lee)-[works at]->(Acme)" in t.reply and t.reply.endswith("user: " + text_) else t.reply
        rows.append((i, t.handler, reply, g.events.count(), past.count()))
    return spark.createDataFrame(rows, "place int, handler string, reply string, events int, turns int")


@query("SELECT * FROM (VALUES (0, 'seeding'), (1, 'community'), (2, 'expansion'), (3, 'reinforcement'), (4, 'formatting')) v(place, stage)")
def stage_timings(spark, sf):
    """The five stages of a retrieval, timed and counted."""
    g = maintain.refresh_weights(event_graph(spark, sf), NOW_MS, Params())
    _, _, seen = stages.timed_retrieve(g, [0.0], ["u1"], Params.v1(), NOW_MS)
    return seen.frame(spark).filter("seconds >= 0 and rows >= 0").select("place", "stage")


# ---- no SQL form ----


@query()
def leiden_communities(spark, sf):
    e = nearest.similar_pairs(vector_graph(spark, sf).entities, 10, 0.25, 10.0, "raw").select("src", "dst", F.col("score").alias("w"))
    return communities.leiden(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")))


@query()
def steiner_tree(spark, sf):
    """The tree between three seeds in the 500 best nodes around them."""
    g = vector_graph(spark, sf)
    g = g.having(edges_similar=_similar(spark, sf))
    p = Params.v2()
    seeds = ["V0", "V5", "V9"]
    nodes, edges = reason.subgraph(g, seeds, p)
    return steiner.steiner_tree(reason.costed(nodes, edges, p), nodes.filter(F.col("text").isin(seeds)).select("node"))


@query()
def reason_answer(spark, sf):
    g = vector_graph(spark, sf)
    return reason.answer(g.having(edges_similar=_similar(spark, sf)), ["V0", "V5", "V9"], Params.v2())


@query()
def maintenance_cycle(spark, sf):
    """Decay and communities of the event graph: nodes by community."""
    g = maintain.maintenance(event_graph(spark, sf), NOW_MS, Params())
    return reason.labelled_nodes(g).select("node", "community_id")


