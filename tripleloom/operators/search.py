"""One-hop search, path scoring, probabilistic update and deletion."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import triple_text
from ..functions.vector import cosine, literal
from ..schema import Params
from ..sources.store import Graph, conform, triples
from .nearest import top_k


def around(graph: Graph, anchors: DataFrame) -> DataFrame:
    """Distinct facts with an anchor (text) as subject or object: subject, relation, object, is_current, start_date."""
    t, names = triples(graph), anchors.select("text").distinct()
    out = t.join(names.withColumnRenamed("text", "subject"), "subject", "left_semi")
    into = t.join(names.withColumnRenamed("text", "object"), "object", "left_semi")
    both = out.unionByName(into.select(out.columns)).distinct()
    facts = graph.events.select(F.col("text").alias("event"), "is_current", "start_date")
    return both.join(facts, "event", "left").select("subject", F.col("event").alias("relation"), "object", "is_current", "start_date")


def search(graph: Graph, vector: list[float], params: Params) -> DataFrame:
    """What is known around the entity nearest to a vector; expired facts are shown as such."""
    anchor = top_k(graph.entities, "text", vector, 1, params.search_threshold, mode=params.score_mode)
    return around(graph, anchor)


def knowledge(graph: Graph, anchors: DataFrame) -> DataFrame:
    """A row for each anchor (text) that is an entity: its facts as lists, as subject (outgoing) and as object (incoming), each in order."""
    t, names = triples(graph), graph.entities.select("text").join(anchors.select("text").distinct(), "text", "left_semi")
    line = triple_text(F.col("subject"), F.col("event"), F.col("object"))
    out = names
    for side, name in (("subject", "outgoing"), ("object", "incoming")):
        own = t.join(names.withColumnRenamed("text", side), side, "left_semi").groupBy(F.col(side).alias("text")).agg(F.array_sort(F.collect_set(line)).alias(name))
        out = out.join(own, "text", "left").withColumn(name, F.coalesce(name, F.array().cast("array<string>")))
    return out


def search_report(facts: DataFrame) -> DataFrame:
    """triple, is_current, start_date as text; a missing date is the word None; rows without a relation go."""
    named = facts.filter(F.col("relation").isNotNull() & (F.col("relation") != ""))
    return named.select(triple_text(F.col("subject"), F.col("relation"), F.col("object")).alias("triple"), "is_current", F.coalesce(F.col("start_date").cast("string"), F.lit("None")).alias("start_date"))


def score_paths(graph: Graph, subjects: DataFrame, objects: DataFrame, relation: list[float], params: Params) -> DataFrame:
    """Current paths between candidate subjects and objects (text, score): s_score, e_score, o_score and their product."""
    current = graph.events.filter("is_current").select(F.col("text").alias("event"), cosine(F.col("embedding"), literal(relation), params.score_mode).alias("e_score"))
    s, o = subjects.select(F.col("text").alias("subject"), F.col("score").alias("s_score")), objects.select(F.col("text").alias("object"), F.col("score").alias("o_score"))
    paths = triples(graph).join(s, "subject").join(o, "object").join(current, "event")
    return paths.withColumn("total", F.coalesce("s_score", F.lit(0.0)) * F.coalesce("o_score", F.lit(0.0)) * F.coalesce("e_score", F.lit(0.0)))


def best_path(paths: DataFrame) -> DataFrame:
    """The path of the highest positive product; ties go to the first by name."""
    return paths.filter("total > 0").orderBy(F.desc("total"), "subject", "event", "object").limit(1)


@dataclass(frozen=True)
class Change:
    subject: list[float]
    old_object: list[float]
    relation: str
    relation_embedding: list[float]
    new_object: str
    new_object_embedding: list[float]
    source_query: str


def _add(column: str, value: str):
    old = F.coalesce(column, F.array().cast("array<string>"))
    return F.array_distinct(F.concat(old, F.array(F.lit(value))))


def update(graph: Graph, change: Change, now_ms: int, params: Params, strict: bool = False) -> Graph:
    """Expire the fact that fits best and add the new one, if the product reaches ``update_score``; else the graph as it is.

    When the new relation has the text of the expired one it is the same event: by default that event is current again and
    loses its edge to the old object; ``strict`` leaves it expired with both edges.
    """
    finds = [top_k(graph.entities, "text", v, params.update_candidates, params.update_threshold, mode=params.score_mode).select("text", "score") for v in (change.subject, change.old_object)]
    hit = best_path(score_paths(graph, *finds, change.relation_embedding, params)).filter(F.col("total") >= params.update_score).collect()  # at most one row
    if not hit:
        return graph
    subject, old_event, old_object = hit[0]["subject"], hit[0]["event"], hit[0]["object"]
    now, again = F.timestamp_millis(F.lit(now_ms)), old_event == change.relation
    e = graph.events
    ended = e.withColumns({"is_current": F.when(F.col("text") == old_event, F.lit(False)).otherwise(F.col("is_current")), "end_date": F.when(F.col("text") == old_event, now).otherwise(F.col("end_date"))})
    same = F.col("text") == change.relation
    noted = ended.withColumns({"synonyms": F.when(same, _add("synonyms", change.relation)).otherwise(F.col("synonyms")), "source_queries": F.when(same, _add("source_queries", change.source_query)).otherwise(F.col("source_queries"))})
    if again and not strict:
        noted = noted.withColumns({"is_current": F.when(same, F.lit(True)).otherwise(F.col("is_current")), "start_date": F.when(same, now).otherwise(F.col("start_date"))})
    spark = graph.spark
    one = spark.range(1)
    event = one.select(F.lit(change.relation).alias("text"), literal(change.relation_embedding).alias("embedding"), F.lit(now_ms).alias("created_at"), F.lit(True).alias("is_current"), now.alias("start_date"), F.array(F.lit(change.relation)).alias("synonyms"), F.array(F.lit(change.source_query)).alias("source_queries"))
    entity = one.select(F.lit(change.new_object).alias("text"), literal(change.new_object_embedding).alias("embedding"), F.lit(now_ms).alias("created_at"), F.array(F.lit(change.new_object)).alias("synonyms"))
    known = graph.entities.withColumn("synonyms", F.when(F.col("text") == change.new_object, _add("synonyms", change.new_object)).otherwise(F.col("synonyms")))
    weight = F.lit(None).cast("double").alias("weight")
    target = graph.edges_target
    if again and not strict:
        target = target.filter(~((F.col("event") == old_event) & (F.col("entity") == old_object)))
    add = lambda old, new, keys: old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)
    return graph.having(
        events=add(noted, conform(event, "events"), ["text"]),
        entities=add(known, conform(entity, "entities"), ["text"]),
        edges_source=add(graph.edges_source, one.select(F.lit(subject).alias("entity"), F.lit(change.relation).alias("event"), weight), ["entity", "event"]),
        edges_target=add(target, one.select(F.lit(change.relation).alias("event"), F.lit(change.new_object).alias("entity"), weight), ["event", "entity"]),
    )


def degrees(graph: Graph) -> DataFrame:
    """text, n: edges of every kind at each entity."""
    ends = graph.edges_source.select("entity").unionByName(graph.edges_target.select("entity"))
    for side in ("src", "dst"):
        ends = ends.unionByName(graph.edges_similar.select(F.col(side).alias("entity")))
    return ends.groupBy(F.col("entity").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def delete_events(graph: Graph, gone: DataFrame) -> Graph:
    """Without the events (text) and their edges, and without the entities that had one of them and now have no edge. Contexts stay."""
    names = gone.select(F.col("text").alias("event")).distinct()
    neighbours = graph.edges_source.join(names, "event", "left_semi").select("entity").unionByName(graph.edges_target.join(names, "event", "left_semi").select("entity")).distinct()
    left = graph.having(
        events=graph.events.join(names.withColumnRenamed("event", "text"), "text", "left_anti").select(graph.events.columns),
        **{n: getattr(graph, n).join(names, "event", "left_anti").select(getattr(graph, n).columns) for n in ("edges_source", "edges_target", "edges_derived")},
    )
    orphans = neighbours.withColumnRenamed("entity", "text").join(degrees(left), "text", "left_anti")
    return left.having(entities=graph.entities.join(orphans, "text", "left_anti").select(graph.entities.columns))
