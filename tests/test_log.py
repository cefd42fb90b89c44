from pyspark.sql import functions as F

from tidemark.functions import checksums
from tidemark.sources import log

SCHEMA = "segment long, offset long, op string, key string, ts long, value string"
ROWS = [
    (1, 0, "put", "a", 1, "a1"),
    (1, 1, "put", "b", 2, "b1"),
    (1, 2, "put", "c", 3, "lost"),
    (2, 0, "put", "a", 4, "a2"),
    (2, 1, "delete", "b", 5, None),
    (2, 2, "put", "d", 6, ""),
]


def test_round_trip_and_replay(spark, tmp_path):
    path = str(tmp_path / "log")
    log.append(spark.createDataFrame(ROWS[:3], SCHEMA), path)
    log.append(spark.createDataFrame(ROWS[3:], SCHEMA), path)
    read = log.read(spark, path).withColumn("segment", F.col("segment").cast("long"))
    assert sorted((r.key, r.value) for r in log.replay(read).collect()) == [("a", "a2"), ("c", "lost"), ("d", "")]
    assert log.replay_versions(read).count() == 6
    assert {r.segment for r in log.prune_segments(read, 1).collect()} == {2}


def test_a_bad_record_ends_its_segment_only(spark):
    sealed = log.seal(spark.createDataFrame(ROWS, SCHEMA))
    torn = sealed.withColumn("value", F.when((F.col("segment") == 1) & (F.col("offset") == 1), "torn").otherwise(F.col("value")))
    assert sorted((r.key, r.value) for r in log.replay(torn).collect()) == [("a", "a2"), ("d", "")]
    assert log.replay(sealed.limit(0)).count() == 0


def test_checksum_tells_null_from_empty_and_columns_apart(spark):
    rows = [(1, 0, "put", "ab", 1, "c"), (1, 0, "put", "a", 1, "bc"), (1, 0, "put", "ab", 1, None), (1, 0, "put", "ab", 1, "")]
    assert log.seal(spark.createDataFrame(rows, SCHEMA)).select("crc").distinct().count() == 4


def test_segments_begin_anew_and_old_files_go(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.range(95).select(log.segment_of(F.col("id"), 10).alias("segment"), F.col("id").alias("offset"), F.lit("put").alias("op"), F.col("id").cast("string").alias("key"), F.col("id").alias("ts"), F.lit("v").alias("value"))
    log.append(rows, path)
    assert log.segments(spark, path) == list(range(10))
    assert log.remove_segments(spark, path, 3) == list(range(7)) and log.segments(spark, path) == [7, 8, 9]
    assert log.replay(log.read(spark, path)).count() == 25
    assert log.remove_segments(spark, path, 99) == []


def test_crc32c(spark):
    vectors = {b"123456789": 0xE3069283, b"": 0, b"a": 0xC1D04330, b"\0" * 32: 0x8A9136AA, b"\xff" * 32: 0x62A8AB43}
    df = spark.createDataFrame([(bytearray(k),) for k in vectors], "b binary")
    assert {bytes(r.b): r.c for r in df.select("b", checksums.crc32c(F.col("b")).alias("c")).collect()} == vectors
    sealed = log.seal(spark.createDataFrame(ROWS, SCHEMA), "crc32c")
    torn = sealed.withColumn("value", F.when(F.col("value") == "b1", "torn").otherwise(F.col("value")))
    assert sorted((r.key, r.value) for r in log.replay(torn, "crc32c").collect()) == [("a", "a2"), ("d", "")]


def test_crc32c_of_every_length_and_with_the_record_built_once(spark):
    def want(data):
        crc = 0xFFFFFFFF
        for byte in data:
            crc ^= byte
            for _ in range(8):
                crc = crc >> 1 ^ (checksums.CASTAGNOLI if crc & 1 else 0)
        return crc ^ 0xFFFFFFFF

    held = [bytes((i * i * 37 + n) % 256 for i in range(n)) for n in (*range(40), 4099)]
    df = spark.createDataFrame([(bytearray(b),) for b in held], "b binary")
    assert all(r.c == want(bytes(r.b)) for r in df.select("b", checksums.crc32c(F.col("b")).alias("c")).collect())
    plan = log.seal(spark.createDataFrame(ROWS, SCHEMA), "crc32c")._jdf.queryExecution().optimizedPlan().toString()
    each = plan[plan.index("lambdafunction(") : plan.index(" AS crc")]
    assert "lambda" in each and "value#" not in each  # else the record is put together again for each of its bytes
