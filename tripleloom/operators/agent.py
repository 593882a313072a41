"""One utterance through the engine: route, write or read, and keep the history. Models are plugged in as columns.

``Models.answer`` gives a language model's JSON answer for an utterance, ``Models.embed`` a vector for a text; both take and return a
Column, so a table lookup, a built-in expression or a pandas UDF will do.

Defined results: an answer that is no JSON, or names no known tool, goes to ``error``, which changes nothing; an answer without a whole triple
writes nothing; a question without a vector is retrieved by names alone.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import extract
from ..schema import BATCH, FRAMES, PART, Params
from ..sources.scratch import stored
from ..sources.store import Graph, conform
from .history import append_turns, prompt_window
from .ingest import upsert
from .maintain import maintenance, reinforce
from .resolve import resolve_batch
from .retrieve import report, retrieve

HISTORY = "session string, turn bigint, role string, text string"


@dataclass(frozen=True)
class Models:
    answer: Callable[[Column], Column]
    embed: Callable[[Column], Column]


def batch_of(answers: DataFrame, models: Models) -> DataFrame:
    """The triple batch of answers (seq, text, answer): one row for each whole triple, embedded, with the utterance as context."""
    rows = extract.triples(answers.select("seq", F.col("text").alias("said"), "answer")).select((F.col("seq") * 1000 + F.col("place")).alias("seq"), "said", "subject", "relation", "object")
    vector = lambda c: models.embed(c).cast("array<double>")
    part = lambda c: F.struct(F.col(c).alias("text"), F.col(c).alias("original"), vector(F.col(c)).alias("embedding")).cast(PART)
    context = F.struct(F.col("said").alias("text"), F.lit("utterance").alias("source"), F.lit(None).cast("string").alias("veracity"), F.lit(None).cast("string").alias("date"))
    out = rows.select("seq", part("subject").alias("subject"), F.struct(F.col("relation").alias("text"), vector(F.col("relation")).alias("embedding")).alias("relation"), part("object").alias("object"), context.alias("context"))
    return answers.sparkSession.createDataFrame([], BATCH).unionByName(out)


@dataclass(frozen=True)
class Turn:
    """What an utterance led to: the graph and history after it, which handler took it, and the text for the model or the user."""

    graph: Graph
    history: DataFrame
    handler: str
    reply: str
    facts: DataFrame | None = None


@dataclass(frozen=True)
class Agent:
    """Handlers by tool name; others may be added."""

    models: Models
    params: Params = field(default_factory=Params.v1)
    handlers: dict[str, Callable] = field(default_factory=lambda: {"information": write, "other": read})

    def handle(self, graph: Graph, history: DataFrame, session: str, utterance: str, now_ms: int) -> Turn:
        """Route one utterance of a session to its handler."""
        spark = graph.spark
        said = spark.createDataFrame([(0, utterance)], "seq bigint, text string").withColumn("answer", self.models.answer(F.col("text")))
        tool = extract.routed(said, known=tuple(self.handlers)).first()["handler"]  # one row
        if tool not in self.handlers:
            return Turn(graph, history, "error", "the request was not understood")
        return self.handlers[tool](self, graph, history, session, said, now_ms)

    def remembered(self, history: DataFrame, session: str, turns: list[tuple[str, str]]) -> DataFrame:
        """History with new turns (role, text) of the session, capped."""
        last = history.filter(F.col("session") == session).agg(F.coalesce(F.max("turn"), F.lit(-1)).alias("t")).first()["t"]
        new = history.sparkSession.createDataFrame([(session, last + 1 + i, role, text) for i, (role, text) in enumerate(turns)], HISTORY)
        return stored(append_turns(history, new, "session", "turn", self.params.history_cap), "history")


def settled(graph: Graph) -> Graph:
    """The graph with its frames written, so that a later turn does not work out this one again."""
    return graph.having(**{name: stored(conform(getattr(graph, name), name), name) for name in FRAMES})


def write(agent: Agent, graph: Graph, history: DataFrame, session: str, said: DataFrame, now_ms: int) -> Turn:
    """Resolve, upsert and maintain the facts of an utterance; confirm how many there were."""
    batch = stored(batch_of(said, agent.models), "batch")
    n = batch.count()
    if n:
        resolved = stored(resolve_batch(batch, graph.entities, agent.params), "resolved")
        graph = settled(maintenance(upsert(graph, resolved, now_ms, agent.params), now_ms, agent.params))
    text = said.first()["text"]
    reply = f"noted: {n} facts"
    return Turn(graph, agent.remembered(history, session, [("user", text), ("model", reply)]), "information", reply)


def read(agent: Agent, graph: Graph, history: DataFrame, session: str, said: DataFrame, now_ms: int) -> Turn:
    """Retrieve facts around a question, reinforce them, and build the prompt from them and the session's last turns. The question joins the history."""
    row = said.withColumn("vector", agent.models.embed(F.col("text")).cast("array<double>")).first()
    names = [r["name"] for r in extract.entity_names(said, "seq").orderBy("name").collect()]  # those of one answer
    facts = stored(retrieve(graph, row["vector"] or [0.0], names, agent.params), "facts")
    lines = report(facts).collect()  # at most ``top_rows`` facts
    window = prompt_window(history.filter(F.col("session") == session), "session", "turn", "role", "text", agent.params.history_window).collect()
    known = "\n".join(f"[{r['topic']}] {r['context_text']}\n{r['facts']}" for r in lines)
    prompt = "\n\n".join(x for x in (known, window[0]["window"] if window else "", f"user: {row['text']}") if x)
    graph = graph.having(events=stored(reinforce(graph.events, facts.select("relation"), now_ms), "events"))
    return Turn(graph, agent.remembered(history, session, [("user", row["text"])]), "other", prompt, facts)
