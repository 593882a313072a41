"""Stage timings of a retrieval, logged and returned as a frame."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..schema import Params
from ..sources.scratch import stored
from ..sources.store import Graph
from .maintain import reinforce
from .retrieve import dominant_community, expand, hybrid_seeds, report

LOG = logging.getLogger("tripleloom")


class Stages:
    """Seconds and rows of named steps."""

    def __init__(self):
        self.found: list[tuple[str, float, int]] = []

    @contextmanager
    def step(self, name: str) -> Iterator[list[int]]:
        rows, began = [0], time.monotonic()
        yield rows
        self.found.append((name, time.monotonic() - began, rows[0]))
        LOG.info("%s: %.3f s, %d rows", *self.found[-1])

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, *x) for i, x in enumerate(self.found)], "place int, stage string, seconds double, rows long")


def counted(df: DataFrame, name: str, rows: list[int]) -> DataFrame:
    """``df`` stored; its rows are counted by the write itself."""
    seen = Observation(name)
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), name)
    rows[0] = seen.get["rows"]
    return out


def timed_retrieve(graph: Graph, vector: list[float], names: list[str], params: Params, now_ms: int) -> tuple[DataFrame, Graph, Stages]:
    """The report of a retrieval, the graph with its facts reinforced, and the five stages: seeding, community, expansion, reinforcement, formatting."""
    stages = Stages()
    with stages.step("seeding") as n:
        seeds = counted(hybrid_seeds(graph.entities, vector, names, params), "seeds", n)
    with stages.step("community") as n:
        best = dominant_community(graph.entities.join(seeds, "text", "left_semi")).collect()  # at most one row
        n[0] = len(best)
    with stages.step("expansion") as n:
        facts = counted(expand(graph, seeds, best[0]["community_id"] if best else None, params), "facts", n)
    with stages.step("reinforcement") as n:
        events = counted(reinforce(graph.events, facts.select("relation"), now_ms), "events", n)
    with stages.step("formatting") as n:
        text = counted(report(facts), "report", n)
    return text, graph.having(events=events), stages
