"""Commit validation and reader bookkeeping as joins and aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_write(writes: DataFrame, keys: Sequence[str], slack: int = 0, width: int = 1024) -> DataFrame:
    """Pairs of transactions that wrote the same key while the later one could not see the earlier.

    ``writes`` has ``txn, read_ts, commit_ts`` (``txn`` in commit order) and the keys, one row per written key. The
    first committer wins: a pair is (loser ``txn``, ``winner``, key). Only commits between a loser's read and its own
    commit are looked at: they are joined by cells of ``width`` timestamps, so a key that every transaction writes
    costs each of them its own time span.
    """
    cell = lambda c: F.floor(c / width).cast("long")
    since = F.col("read_ts") - slack
    later = writes.select("txn", since.alias("_since"), *keys, F.explode(F.sequence(cell(F.least(since, F.col("commit_ts"))), cell(F.col("commit_ts")))).alias("_cell"))
    earlier = writes.select(F.col("txn").alias("winner"), F.col("commit_ts").alias("_commit"), *keys, cell(F.col("commit_ts")).alias("_cell"))
    found = later.join(earlier, [*keys, "_cell"]).where((F.col("winner") < F.col("txn")) & (F.col("_commit") > F.col("_since")))
    return found.select("txn", "winner", *keys)


def losers(writes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The written keys (``txn`` and key) that first-committer-wins refuses: another commit of the key came after the read.

    No pairs are made: in commit order, the last commit before a transaction's own says it all.
    """
    before = Window.partitionBy(*keys).orderBy("commit_ts", "txn")
    found = writes.withColumn("_last", F.lag("commit_ts").over(before)).where(F.col("_last") > F.col("read_ts"))
    return found.select("txn", *keys)


def read_write(reads: DataFrame, writes: DataFrame, keys: Sequence[str], concurrent: Column) -> DataFrame:
    """Keys that a transaction (``txn``) read and a concurrent one (``writer``) wrote: the optional stricter validation."""
    theirs = writes.select(F.col("txn").alias("writer"), *keys).distinct()
    return reads.select("txn", *keys).distinct().join(theirs, list(keys)).where(concurrent).select("txn", "writer", *keys)


def touched(versions: DataFrame, write_set: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of a write set that have a version among ``versions``."""
    return write_set.select(*keys).join(versions.select(*keys), list(keys), "left_semi")


def low_water(active: DataFrame, latest_ts: int | None = None) -> DataFrame:
    """The oldest read timestamp in use, or the latest commit's if nothing is being read."""
    return active.agg(F.coalesce(F.min("read_ts"), F.lit(latest_ts).cast("long")).alias("low_water"))
