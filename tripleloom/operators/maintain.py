"""Time decay, densification, reinforcement, community write-back and the maintenance jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import DAY_MS, Params
from ..sources.store import Graph
from .communities import leiden
from .nearest import similar_pairs


def decayed(created_ms: Column, now_ms: int, rate: float) -> Column:
    """exp(-rate * age in days)."""
    return F.exp(F.lit(-rate) * ((F.lit(now_ms) - created_ms) / F.lit(float(DAY_MS))))


def refresh_weights(graph: Graph, now_ms: int, params: Params) -> Graph:
    """Every source and target edge takes its event's decayed weight; edges of unknown events keep theirs."""
    w = graph.events.select(F.col("text").alias("event"), decayed(F.col("created_at"), now_ms, params.decay).alias("w"))
    new = {}
    for name in ("edges_source", "edges_target"):
        edges = getattr(graph, name)
        new[name] = edges.join(w, "event", "left").withColumn("weight", F.coalesce("w", "weight")).select(edges.columns)
    return graph.having(**new)


def projection(graph: Graph, similar: bool, weighted: bool) -> DataFrame:
    """Undirected edges (src, dst, w) between entity and event nodes, each direction a row; nodes are ``N:text`` and ``E:text``."""
    entity, event = (lambda c: F.concat(F.lit("N:"), c)), (lambda c: F.concat(F.lit("E:"), c))
    w = F.coalesce("weight", F.lit(1.0)) if weighted else F.lit(1.0)
    parts = [getattr(graph, n).select(entity(F.col("entity")).alias("src"), event(F.col("event")).alias("dst"), w.alias("w")) for n in ("edges_source", "edges_target")]
    if similar:
        parts.append(graph.edges_similar.select(entity(F.col("src")).alias("src"), entity(F.col("dst")).alias("dst"), F.lit(1.0).alias("w")))
    one = parts[0]
    for p in parts[1:]:
        one = one.unionByName(p)
    one = one.filter("w > 0")
    return one.unionByName(one.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


def densify(graph: Graph, params: Params) -> Graph:
    """Adds edges between similar entities; an edge that exists keeps its score."""
    new = similar_pairs(graph.entities, params.similar_k, params.similar_threshold, params.costs["SIMILAR_TO"], params.score_mode)
    fresh = new.join(graph.edges_similar.select("src", "dst"), ["src", "dst"], "left_anti")
    return graph.having(edges_similar=graph.edges_similar.unionByName(fresh))


def write_communities(graph: Graph, assigned: DataFrame) -> Graph:
    """community_id of every node that was assigned one; nodes outside the projection keep theirs."""
    new = {}
    for name, mark in (("entities", "N:"), ("events", "E:")):
        rows = getattr(graph, name)
        own = assigned.filter(F.col("node").startswith(mark)).select(F.substring("node", 3, 1 << 30).alias("text"), F.col("community").alias("c"))
        new[name] = rows.join(own, "text", "left").withColumn("community_id", F.coalesce("c", "community_id")).select(rows.columns)
    return graph.having(**new)


def cluster(graph: Graph, params: Params, similar: bool) -> Graph:
    return write_communities(graph, leiden(projection(graph, similar, params.weighted), params.gamma))


def maintenance(graph: Graph, now_ms: int, params: Params) -> Graph:
    """Decay, then communities over the decayed graph."""
    return cluster(refresh_weights(graph, now_ms, params), params, similar=False)


def background(graph: Graph, params: Params) -> Graph:
    """Densify, then communities over facts and similarity edges."""
    return cluster(densify(graph, params), params, similar=True)


def reinforce(events: DataFrame, relations: DataFrame, now_ms: int) -> DataFrame:
    """Events among the distinct relations are created and accessed now; their edges change at the next decay."""
    hit = relations.select(F.col("relation").alias("text")).distinct().withColumn("hit", F.lit(True))
    now = F.when(F.col("hit"), F.lit(now_ms))
    return events.join(hit, "text", "left").withColumns({"created_at": F.coalesce(now, F.col("created_at")), "last_accessed": F.coalesce(now, F.col("last_accessed"))}).select(events.columns)
