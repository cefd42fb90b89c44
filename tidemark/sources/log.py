"""A checksummed, segmented log of writes, and its replay.

A record is ``segment, offset, op ('put' or 'delete'), key, ts, value, crc``. Replay keeps of each
segment the records before the first that its checksum rejects, and of each key the last record in
(segment, offset) order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.checksums import record_crc, record_crc32c
from tidemark.operators.versions import first_per_key
from tidemark.sources.manifest import Store

CHECKED = ("segment", "offset", "op", "key", "ts", "value")
#: Checksums by name; all records of a log have the same.
CHECKSUMS = {"crc32": record_crc, "crc32c": record_crc32c}


def seal(records: DataFrame, checksum: str = "crc32") -> DataFrame:
    """``records`` with their checksum."""
    return records.withColumn("crc", CHECKSUMS[checksum](*CHECKED))


def append(records: DataFrame, path: str, checksum: str = "crc32") -> None:
    """Append sealed records; segments become folders, so that replay of some reads only those."""
    seal(records, checksum).write.mode("append").partitionBy("segment").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def valid_prefix(df: DataFrame, segment: str, offset: str, valid: Column) -> DataFrame:
    """Per segment the rows before the first invalid one."""
    first_bad = df.groupBy(segment).agg(F.min(F.when(~valid, F.col(offset))).alias("_bad"))
    return df.join(first_bad, segment).where(F.col("_bad").isNull() | (F.col(offset) < F.col("_bad"))).drop("_bad")


def replay(log: DataFrame, checksum: str = "crc32") -> DataFrame:
    """The state that a log leaves: the last record of every key, deletes gone."""
    good = valid_prefix(log, "segment", "offset", F.col("crc") == CHECKSUMS[checksum](*CHECKED))
    last = first_per_key(good, ["key"], [F.desc("segment"), F.desc("offset")])
    return last.where(F.col("op") == "put").select("key", "ts", "value")


def replay_versions(log: DataFrame, checksum: str = "crc32") -> DataFrame:
    """All versions that a log holds, for a versioned table; equal (key, ts): the last record."""
    good = valid_prefix(log, "segment", "offset", F.col("crc") == CHECKSUMS[checksum](*CHECKED))
    last = first_per_key(good, ["key", "ts"], [F.desc("segment"), F.desc("offset")])
    return last.select("key", "ts", (F.col("op") == "delete").alias("is_tombstone"), "value")


def prune_segments(log: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` segments."""
    newest = log.select("segment").distinct().withColumn("_n", F.row_number().over(Window.orderBy(F.desc("segment"))))
    return log.join(newest.where(F.col("_n") <= keep).select("segment"), "segment", "left_semi")


def segment_of(offset: Column, records: int) -> Column:
    """The segment of a record whose offset counts on over all segments: a new one begins every ``records`` records."""
    return F.floor(offset / records).cast("long")


def segments(spark: SparkSession, path: str) -> list[int]:
    """The segments of a stored log, from its folders."""
    return sorted(int(n.partition("=")[2]) for n in Store(spark, path).names("") if n.startswith("segment="))


def remove_segments(spark: SparkSession, path: str, keep: int) -> list[int]:
    """Delete the files of all but the newest ``keep`` segments of a stored log; the segments that went."""
    held = segments(spark, path)
    gone = held[: max(0, len(held) - keep)]
    store = Store(spark, path)
    for n in gone:
        store.delete(f"segment={n}")
    return gone
