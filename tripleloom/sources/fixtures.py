"""The driver's tables as graphs, through the same frames that the store holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import Graph, conform, empty

NOW_MS = 1_709_251_200_000  # 2024-03-01T00:00Z


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def name(prefix: str, column: str) -> Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def event_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """users -SOURCE-> events -TARGET-> event types; a user's and its events' community is user_id % 10."""
    e = table(spark, sf_dir, "events")
    rows = e.select(name("u", "user_id").alias("u"), name("e", "event_id").alias("e"), name("t", "event_type").alias("t"), millis(F.col("ts")).alias("created_at"), (F.col("user_id") % 10).alias("c"))
    users = rows.groupBy(F.col("u").alias("text")).agg(F.first("c").alias("community_id"))
    types = rows.select(F.col("t").alias("text")).distinct().withColumn("community_id", F.lit(None).cast("bigint"))
    return empty(spark).having(
        entities=conform(users.unionByName(types), "entities"),
        events=conform(rows.select(F.col("e").alias("text"), "created_at", F.lit(True).alias("is_current"), F.col("c").alias("community_id")), "events"),
        edges_source=conform(rows.select(F.col("u").alias("entity"), F.col("e").alias("event")), "edges_source"),
        edges_target=conform(rows.select(F.col("e").alias("event"), F.col("t").alias("entity")), "edges_target"),
    )


def order_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """customers -SOURCE-> orders -TARGET-> parts; an order's context is its priority; communities are nations and part sizes."""
    orders, items, customers, parts = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "customer", "part"))
    placed = orders.join(customers.select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey", "left")
    people = customers.select(name("C", "c_custkey").alias("text"), F.col("c_nationkey").alias("community_id"))
    things = parts.select(name("P", "p_partkey").alias("text"), F.col("p_size").alias("community_id"))
    events = placed.select(name("O", "o_orderkey").alias("text"), millis(F.col("o_orderdate")).alias("created_at"), (F.col("o_orderstatus") != "F").alias("is_current"), F.col("c_nationkey").alias("community_id"))
    return empty(spark).having(
        entities=conform(people.unionByName(things), "entities"),
        events=conform(events, "events"),
        contexts=conform(orders.select(F.col("o_orderpriority").alias("text")).distinct(), "contexts"),
        edges_source=conform(orders.select(name("C", "o_custkey").alias("entity"), name("O", "o_orderkey").alias("event")).distinct(), "edges_source"),
        edges_target=conform(items.select(name("O", "l_orderkey").alias("event"), name("P", "l_partkey").alias("entity")).distinct(), "edges_target"),
        edges_derived=conform(orders.select(name("O", "o_orderkey").alias("event"), F.col("o_orderpriority").alias("context")), "edges_derived"),
    )


def vector_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """A ring of vectors: V(i) -SOURCE-> E(i) -TARGET-> V(i + 1), with the vector of i at V(i) and E(i)."""
    v = table(spark, sf_dir, "embeddings")
    own = v.select("vec_id", name("V", "vec_id").alias("text"), F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("bigint").alias("community_id"))
    after = own.select((F.col("vec_id") - 1).alias("vec_id"), F.col("text").alias("next"))
    ring = own.join(after, "vec_id").select(name("E", "vec_id").alias("event"), "text", "next", "embedding")
    return empty(spark).having(
        entities=conform(own, "entities"),
        events=conform(ring.select(F.col("event").alias("text"), "embedding", F.lit(NOW_MS).alias("created_at"), F.lit(True).alias("is_current")), "events"),
        edges_source=conform(ring.select(F.col("text").alias("entity"), "event"), "edges_source"),
        edges_target=conform(ring.select("event", F.col("next").alias("entity")), "edges_target"),
    )


def vector_of(graph: Graph, text: str) -> list[float]:
    return list(graph.entities.filter(F.col("text") == text).select("embedding").first()[0])
