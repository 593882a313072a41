"""Bulk upsert of reified triples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Params
from ..sources.store import Graph, conform


def merge_edges(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Set union by key; an edge that exists keeps its properties."""
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh, allowMissingColumns=True)


def mentions(batch: DataFrame, order: str) -> DataFrame:
    """text, original, embedding and the order of every subject and object of the batch."""
    out = None
    for role, name in enumerate(("subject", "object")):
        rank = F.struct(F.lit(role).alias("a"), F.col("seq").alias("b")) if order == "role" else F.struct(F.col("seq").alias("a"), F.lit(role).cast("long").alias("b"))
        own = batch.select(F.col(f"{name}.text").alias("text"), F.col(f"{name}.original").alias("original"), F.col(f"{name}.embedding").alias("embedding"), F.struct(rank["a"].cast("long").alias("a"), rank["b"].cast("long").alias("b")).alias("ord"))
        out = own if out is None else out.unionByName(own)
    return out.filter("text is not null")


def pick(policy: str):
    return F.max_by if policy == "last" else F.min_by


def ordered_new(said: DataFrame) -> DataFrame:
    """text, fresh: distinct originals that differ from the text, by first mention. Summed by (text, original) first."""
    once = said.filter("original is not null and original != text").groupBy("text", "original").agg(F.min("ord").alias("ord"))
    return once.groupBy("text").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "original"))), lambda x: x["original"]).alias("fresh"))


def upsert_entities(old: DataFrame, batch: DataFrame, now_ms: int, params: Params) -> DataFrame:
    said = mentions(batch, params.mention_order)
    latest = said.filter("embedding is not null").groupBy("text").agg(pick(params.embedding_policy)("embedding", "ord").alias("said_embedding"))
    heads = said.groupBy("text").agg(F.min("ord").alias("first"))
    known = old.select("text", F.lit(True).alias("known"))
    if not params.synonyms_on_create:  # the mention that creates an entity leaves no synonym
        started = heads.join(known, "text", "left_anti").select("text", "first")
        said = said.join(started, "text", "left").filter(F.col("first").isNull() | (F.col("ord") != F.col("first"))).drop("first")
    new = heads.select("text").join(latest, "text", "left").join(ordered_new(said), "text", "left")
    joined = old.join(new.withColumn("said", F.lit(True)), "text", "full_outer")
    none = F.array().cast("array<string>")
    embedding = F.coalesce("said_embedding", "embedding") if params.embedding_policy == "last" else F.coalesce("embedding", "said_embedding")
    merged = joined.select(
        "text",
        embedding.alias("embedding"),
        F.coalesce("created_at", F.lit(now_ms)).alias("created_at"),
        F.array_distinct(F.concat(F.coalesce("synonyms", none), F.coalesce("fresh", none))).alias("synonyms"),
        "community_id",
    )
    return conform(merged, "entities")


def upsert_events(old: DataFrame, batch: DataFrame, now_ms: int, params: Params) -> DataFrame:
    new = batch.filter("relation.text is not null").groupBy(F.col("relation.text").alias("text")).agg(pick(params.embedding_policy)("relation.embedding", F.when(F.col("relation.embedding").isNotNull(), F.col("seq"))).alias("said_embedding"))
    joined = old.withColumn("was", F.lit(True)).join(new, "text", "full_outer")
    embedding = F.coalesce("said_embedding", "embedding") if params.embedding_policy == "last" else F.coalesce("embedding", "said_embedding")
    created = F.lit(True) if params.events_current else F.lit(None).cast("boolean")
    return conform(joined.withColumns({"embedding": embedding, "created_at": F.coalesce("created_at", F.lit(now_ms)), "is_current": F.when(F.col("was"), F.col("is_current")).otherwise(created)}), "events")


def upsert_contexts(old: DataFrame, batch: DataFrame, now_ms: int) -> DataFrame:
    first = batch.filter("context.text is not null").groupBy(F.col("context.text").alias("text")).agg(F.min_by("context", "seq").alias("c"))
    new = first.join(old.select("text"), "text", "left_anti").select("text", F.lit(now_ms).alias("created_at"), "c.source", "c.veracity", "c.date")
    return old.unionByName(conform(new, "contexts"))


def upsert(graph: Graph, batch: DataFrame, now_ms: int, params: Params) -> Graph:
    """The graph with a resolved batch merged in. Applying a batch again adds nothing."""
    e, s, o, c = F.col("relation.text").alias("event"), F.col("subject.text").alias("entity"), F.col("object.text").alias("entity"), F.col("context.text").alias("context")
    weight = F.lit(None).cast("double").alias("weight")
    return graph.having(
        entities=upsert_entities(graph.entities, batch, now_ms, params),
        events=upsert_events(graph.events, batch, now_ms, params),
        contexts=upsert_contexts(graph.contexts, batch, now_ms),
        edges_source=merge_edges(graph.edges_source, batch.select(s, e, weight), ["entity", "event"]),
        edges_target=merge_edges(graph.edges_target, batch.select(e, o, weight), ["event", "entity"]),
        edges_derived=merge_edges(graph.edges_derived, batch.filter("context.text is not null").select(e, c), ["event", "context"]),
    )
