from pyspark.sql import functions as F

from tidemark.streaming.ingest import ingest
from tidemark.table import Options, Table


def test_batches_arrive_once(spark, tmp_path):
    source, schema = tmp_path / "in", "op string, k int, v string"
    t = Table.create(spark, str(tmp_path / "t"), "k int", "v string", Options(strategy_options={"level0_runs": 2}))

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        stream = spark.readStream.schema(schema).json(str(source))
        query = ingest(stream, t, "feed", str(tmp_path / "checkpoint"), tombstone=F.col("op") == "delete", compact=True, availableNow=True)
        query.awaitTermination(120)
        assert query.exception() is None

    feed([("put", 1, "a"), ("put", 2, "b")])
    feed([("delete", 1, None), ("put", 3, "c")])
    assert [tuple(r) for r in t.scan().collect()] == [(2, "b"), (3, "c")]
    assert t.state().batches == {"feed": 1}
    again = spark.createDataFrame([(9, "x")], "k int, v string")
    version = t.state().version
    assert t.state().batches.get("feed", -1) >= 1  # a repeated batch is recognised by its number
    t.write(again, info={"stream": "feed", "batch": 2})
    assert t.state().version == version + 1 and t.state().batches == {"feed": 2}


def test_the_last_event_of_a_key_wins_within_a_batch(spark, tmp_path):
    t = Table.create(spark, str(tmp_path / "t"), "k int", "v string")
    rows = [(1, 1, "a", False), (2, 1, "b", False), (3, 1, None, True), (1, 2, None, True), (2, 2, "c", False)]
    spark.createDataFrame(rows, "at int, k int, v string, gone boolean").repartition(3).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("at int, k int, v string, gone boolean").json(str(tmp_path / "in"))
    ingest(stream, t, "feed", str(tmp_path / "c"), tombstone=F.col("gone"), order_by=F.col("at"), availableNow=True).awaitTermination(120)
    assert [tuple(r) for r in t.scan().collect()] == [(2, "c")]
