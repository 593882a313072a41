"""A versioned parquet store of the graph's frames, with one writer."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FRAMES, KEYS


@dataclass(frozen=True)
class Graph:
    """The frames of one version. Operators take a Graph and return another."""

    entities: DataFrame
    events: DataFrame
    contexts: DataFrame
    edges_source: DataFrame
    edges_target: DataFrame
    edges_derived: DataFrame
    edges_similar: DataFrame

    def having(self, **frames: DataFrame) -> Graph:
        return replace(self, **frames)

    @property
    def spark(self) -> SparkSession:
        return self.entities.sparkSession


def empty(spark: SparkSession) -> Graph:
    """No rows, the same schemas: also what clearing the store leaves."""
    return Graph(**{name: spark.createDataFrame([], schema) for name, schema in FRAMES.items()})


def conform(df: DataFrame, frame: str) -> DataFrame:
    """The frame's columns and types; missing ones are null."""
    parts = [p.strip().rsplit(" ", 1) for p in FRAMES[frame].split(", ")]
    return df.select(*((F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in parts))


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once: the uniqueness constraint as a query."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


class Store:
    """Each commit writes a new version folder and then its marker; a reader takes the last version with a marker."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.closed = spark, path.rstrip("/"), False

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def health(self) -> DataFrame:
        """frame, version, rows of the last version: reads the footer of every frame, and fails where one is missing or unreadable."""
        version = self.version()
        if self.closed:
            raise ValueError("the store is closed")
        rows = [(name, version, getattr(self.load(version), name).count()) for name in FRAMES]
        return self.spark.createDataFrame(rows, "frame string, version long, rows long")

    def close(self) -> None:
        """No commit after this; versions stay as they are."""
        self.closed = True

    def prune(self, keep: int = 2) -> list[int]:
        """Delete all but the last ``keep`` committed versions, and what refused commits left; returns the versions that went."""
        fs, path = self._fs()
        last = self.version()
        there = [int(f.getPath().getName()[1:]) for f in fs.listStatus(path(self.path))] if fs.exists(path(self.path)) else []
        gone = sorted(v for v in there if v <= last - keep)
        for v in gone:
            fs.delete(path(f"{self.path}/v{v}"), True)
        return gone

    def version(self) -> int:
        """The last committed version; 0 when there is none."""
        fs, path = self._fs()
        if not fs.exists(path(self.path)):
            return 0
        done = [f.getPath().getName() for f in fs.listStatus(path(self.path)) if fs.exists(path(f"{self.path}/{f.getPath().getName()}/_COMMITTED"))]
        return max((int(n[1:]) for n in done), default=0)

    def load(self, version: int | None = None) -> Graph:
        version = self.version() if version is None else version
        if version == 0:
            return empty(self.spark)
        return Graph(**{name: self.spark.read.schema(schema).parquet(f"{self.path}/v{version}/{name}") for name, schema in FRAMES.items()})

    def commit(self, graph: Graph, check: bool = False) -> int:
        """Write the graph as the next version; with ``check``, refuse frames with repeated keys."""
        if self.closed:
            raise ValueError("the store is closed")
        version = self.version() + 1
        for name in FRAMES:
            conform(getattr(graph, name), name).write.mode("overwrite").parquet(f"{self.path}/v{version}/{name}")
        if check:
            for name, keys in KEYS.items():
                bad = duplicates(self.spark.read.parquet(f"{self.path}/v{version}/{name}"), keys).limit(1).collect()
                if bad:
                    raise ValueError(f"{name} repeats a key: {bad[0].asDict()}")
        fs, path = self._fs()
        fs.create(path(f"{self.path}/v{version}/_COMMITTED")).close()
        return version

    def clear(self) -> int:
        return self.commit(empty(self.spark))


def nodes(graph: Graph) -> DataFrame:
    """All nodes, without embeddings: label, text and the properties of each label."""
    frames = {"Entity": graph.entities, "Event": graph.events, "Context": graph.contexts}
    out = None
    for label, df in frames.items():
        own = df.drop("embedding").withColumn("label", F.lit(label))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out


def lookup(graph: Graph, ids: list[tuple[str, str]]) -> DataFrame:
    """The nodes with these ids (label, text); ids that are not there give no row."""
    asked = graph.spark.createDataFrame(ids, "label string, text string").distinct()
    return nodes(graph).join(F.broadcast(asked), ["label", "text"], "left_semi")  # as many rows as the caller lists


def catalog(graph: Graph) -> DataFrame:
    """frame, place, column, type, is_key: the schema of the store as rows."""
    rows = [(name, i, f.name, f.dataType.simpleString(), f.name in KEYS[name]) for name in FRAMES for i, f in enumerate(getattr(graph, name).schema.fields)]
    return graph.spark.createDataFrame(rows, "frame string, place int, column string, type string, is_key boolean")


def list_nodes(graph: Graph, limit: int = 100) -> DataFrame:
    return nodes(graph).orderBy("label", "text").limit(limit)


def triples(graph: Graph) -> DataFrame:
    """subject, event, object of every pair of a source and a target edge of one event."""
    return graph.edges_source.select(F.col("entity").alias("subject"), "event").join(graph.edges_target.select("event", F.col("entity").alias("object")), "event").select("subject", "event", "object")
