"""Streams driven to their end over files."""

from pyspark.sql import functions as F

from tripleloom.schema import BATCH, Params
from tripleloom.sources.store import Store, triples
from tripleloom.streaming import ingest


def rows(spark, facts, first=0):
    data = [(first + i, (s, s, [1.0, 0.0]), (r, [1.0]), (o, o, [0.0, 1.0]), ("said", None, None, None)) for i, (s, r, o) in enumerate(facts)]
    return spark.createDataFrame(data, BATCH)


def test_ingest_stream(spark, tmp_path):
    folder, store = f"file://{tmp_path}/in", Store(spark, f"file://{tmp_path}/store")
    rows(spark, [("A", "e1", "B"), ("A", "e2", "C")]).coalesce(1).write.mode("append").parquet(folder)

    def run():
        stream = spark.readStream.schema(BATCH).parquet(folder)
        ingest.ingest_stream(stream, store, f"file://{tmp_path}/checkpoint", Params(resolve_threshold=1.1), lambda: 5).awaitTermination()

    run()
    assert {r["subject"] for r in triples(store.load()).collect()} == {"A"} and store.version() == 1
    rows(spark, [("D", "e3", "A"), ("A", "e1", "B")], 10).coalesce(1).write.mode("append").parquet(folder)
    run()
    got = store.load()
    assert got.events.count() == 3 and got.edges_source.count() == 3
    assert got.events.filter("community_id is null").count() == 0
    run()
    assert store.version() == 2


def test_last_access(spark, tmp_path):
    folder = f"file://{tmp_path}/access"
    data = spark.createDataFrame([("e1", "2024-01-01 00:00:00"), ("e1", "2024-01-01 01:00:00"), ("e2", "2024-01-01 00:30:00")], "event string, at string").withColumn("at", F.col("at").cast("timestamp"))
    data.write.parquet(folder)
    stream = ingest.last_access(spark.readStream.schema(data.schema).parquet(folder))
    q = stream.writeStream.format("memory").queryName("seen").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["event"], str(r["last_accessed"])) for r in spark.table("seen").collect()} == {("e1", "2024-01-01 01:00:00"), ("e2", "2024-01-01 00:30:00")}


def test_history_is_capped(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/turns", "conv_id long, turn long, role string, text string"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        out = ingest.history_stream(ingest.turns_of(spark, folder), cap=4, window=2)
        write = out.writeStream.foreachBatch(lambda df, _: df.write.mode("append").parquet(f"file://{tmp_path}/out")).outputMode("update")
        write.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
        return {(r["session"], r["kept"], r["last_turn"], r["recent"]) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}

    try:
        first = run([(1, 0, "user", "a"), (1, 1, "model", "b"), (2, 0, "user", "x")])
        assert first == {(1, 2, 1, "user: a\nmodel: b"), (2, 1, 0, "user: x")}
        assert run([(1, t, "user", str(t)) for t in range(2, 7)]) - first == {(1, 4, 6, "user: 5\nuser: 6")}
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
