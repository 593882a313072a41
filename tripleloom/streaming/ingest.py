"""Structured Streaming: ingest triple batches as they come, keep capped chat histories, count accesses."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.ingest import upsert
from ..operators.maintain import background, maintenance
from ..operators.resolve import resolve_batch
from ..schema import Params
from ..sources.store import Store


def ingest_stream(batches: DataFrame, store: Store, checkpoint: str, params: Params, now_ms, maintain: str | None = "maintenance") -> StreamingQuery:
    """Resolve and upsert each micro-batch of triples, then maintain, as one new store version.

    ``now_ms`` is a callable; ``maintain`` is ``maintenance``, ``background`` or None. A batch that is run again after a
    failure adds nothing, since upserts are sets by key.
    """

    def write(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        graph, now = store.load(), now_ms()
        graph = upsert(graph, resolve_batch(batch, graph.entities, params), now, params)
        if maintain == "maintenance":
            graph = maintenance(graph, now, params)
        elif maintain == "background":
            graph = background(graph, params)
        store.commit(graph)

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class History(StatefulProcessor):
    """The last ``cap`` turns of each session, as state; each batch of new turns gives the session's history as it is then."""

    def __init__(self, cap: int, window: int):
        self.cap, self.window = cap, window

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.turns = handle.getListState("turns", "turn long, role string, text string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.turns.get()]
        for pdf in rows:
            held += list(pdf[["turn", "role", "text"]].itertuples(index=False, name=None))
        held = sorted(held, key=lambda r: r[0])[-self.cap :]
        self.turns.put(held)
        lines = [f"{role}: {text}" for _, role, text in held[-self.window :]]
        yield pd.DataFrame({"session": [key[0]], "kept": [len(held)], "last_turn": [held[-1][0]], "recent": ["\n".join(lines)]})

    def close(self) -> None:
        pass


def history_stream(turns: DataFrame, cap: int = 40, window: int = 20) -> DataFrame:
    """turns (session, turn, role, text) -> session, kept, last_turn, recent (the last ``window`` turns as text), with capped state. It
    needs the RocksDB state store."""
    return turns.groupBy("session").transformWithStateInPandas(History(cap, window), "session long, kept long, last_turn long, recent string", "Update", "none")


def last_access(accesses: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """The latest access of each event out of a stream (or a table) of (event, at), for reinforcement."""
    return accesses.withWatermark("at", delay).groupBy("event").agg(F.max("at").alias("last_accessed"))


def turns_of(spark: SparkSession, path: str) -> DataFrame:
    """A folder of conversation files as a stream of turns."""
    return spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(path).select(F.col("conv_id").alias("session"), "turn", "role", "text")
