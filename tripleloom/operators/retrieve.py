"""Associative retrieval: seeds, dominant community, PageRank expansion, topic order, report."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import past_mark, triple_text
from ..schema import Params
from ..sources.store import Graph, triples
from .fuzzy import fuzzy_hits
from .maintain import projection
from .nearest import top_k
from .pagerank import pagerank

NO_TOPIC = -999


def hybrid_seeds(entities: DataFrame, vector: list[float], names: list[str], params: Params) -> DataFrame:
    """Distinct texts: the nearest by vector over the threshold, exact names, and close spellings of the names."""
    near = top_k(entities, "text", vector, params.seed_vectors, params.search_threshold, strict=True, mode=params.score_mode).select("text")
    exact = entities.filter(F.col("text").isin(names)).select("text") if names else entities.limit(0).select("text")
    long = [n for n in names if len(n) >= params.min_length]
    if not long:
        return near.unionByName(exact).distinct()
    asked = entities.sparkSession.createDataFrame([(n, n) for n in dict.fromkeys(long)], "qkey string, text string")
    close = fuzzy_hits(asked, entities.select("text"), params.seed_fuzzy).filter(F.col("score") > params.seed_fuzzy_score).select(F.col("entity").alias("text"))
    return near.unionByName(exact).unionByName(close).distinct()


def dominant_community(nodes: DataFrame) -> DataFrame:
    """The most frequent community and its count; the lowest of ties. Nodes without one don't vote."""
    return nodes.filter("community_id is not null").groupBy("community_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "community_id").limit(1)


def top_nodes(ranks: DataFrame, nodes: DataFrame, k: int, min_score: float | None) -> DataFrame:
    """The k best nodes. Without ``min_score`` nodes that rank did not reach count with score 0 and may fill the list."""
    full = ranks if min_score is not None else nodes.select("node").distinct().join(ranks, "node", "left").select("node", F.coalesce("score", F.lit(0.0)).alias("score"))
    if min_score is not None:
        full = full.filter(F.col("score") > min_score)
    return full.orderBy(F.desc("score"), "node").limit(k)


def boosted(rows: DataFrame, community: int, limit: int) -> DataFrame:
    """Rows of the dominant community first, then the newest (unknown age first), then by name."""
    order = [F.when(F.col("community") == community, 1).otherwise(0).desc(), F.col("created_at").desc_nulls_first(), "subject", "relation", "object", F.col("context_text")]
    return rows.orderBy(*order).limit(limit)


def facts_of(graph: Graph, top: DataFrame) -> DataFrame:
    """Every triple that a top node takes part in, with its context: one row for each context."""
    t = triples(graph)
    ids = top.select("node").distinct()
    mark = lambda name, prefix: ids.filter(F.col("node").startswith(prefix)).select(F.substring("node", 3, 1 << 30).alias(name))
    hit = None
    for name, prefix in (("subject", "N:"), ("event", "E:"), ("object", "N:")):
        part = t.join(mark(name, prefix), name, "left_semi").select("subject", "event", "object")
        hit = part if hit is None else hit.unionByName(part)
    events = graph.events.select(F.col("text").alias("event"), "created_at", "is_current", F.coalesce("community_id", F.lit(-1)).alias("community"))
    rows = hit.distinct().join(events, "event").join(graph.edges_derived, "event", "left")
    return rows.select("subject", F.col("event").alias("relation"), "object", F.coalesce("context", F.lit("")).alias("context_text"), "community", "is_current", "created_at")


def expand(graph: Graph, seeds: DataFrame, community: int | None, params: Params) -> DataFrame:
    edges = projection(graph, similar=not params.weighted, weighted=params.weighted)
    start = seeds.select(F.concat(F.lit("N:"), "text").alias("node"))
    nodes = graph.entities.select(F.concat(F.lit("N:"), "text").alias("node")).unionByName(graph.events.select(F.concat(F.lit("E:"), "text").alias("node")))
    ranks = pagerank(edges, start.join(nodes, "node", "left_semi"), params.damping, params.iterations).withColumn("score", F.round("score", 9))  # equal ranks tie, whatever the order of their sums
    top = top_nodes(ranks, nodes, params.top_nodes, params.min_score)
    return boosted(facts_of(graph, top), NO_TOPIC if community is None else community, params.top_rows)


def retrieve(graph: Graph, vector: list[float], names: list[str] | Callable[[], list[str]], params: Params) -> DataFrame:
    """At most ``top_rows`` facts around the query; nothing is changed (see ``reinforce``)."""
    seeds = hybrid_seeds(graph.entities, vector, names() if callable(names) else names, params)
    best = dominant_community(graph.entities.join(seeds, "text", "left_semi")).collect()  # at most one row
    return expand(graph, seeds, best[0]["community_id"] if best else None, params)


def seed_communities(entities: DataFrame, seeds: DataFrame) -> DataFrame:
    """text and community (-1 when unknown) of each seed."""
    return entities.join(seeds.select("text"), "text", "left_semi").select("text", F.coalesce("community_id", F.lit(-1)).alias("community"))


def report(rows: DataFrame, unclassified: str = "unclassified") -> DataFrame:
    """community, topic, context_text, facts: lines grouped by community and context, in order."""
    line = F.concat(triple_text(F.col("subject"), F.col("relation"), F.col("object")), past_mark(F.col("is_current")))
    topic = F.when(F.col("community") == -1, F.lit(unclassified)).otherwise(F.concat(F.lit("topic "), F.col("community").cast("string")))
    grouped = rows.groupBy("community", "context_text").agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("facts"))
    return grouped.select("community", topic.alias("topic"), "context_text", "facts").orderBy("community", "context_text")
