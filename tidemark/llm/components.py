"""Connected components of a link table by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join on the same key, so a node
with very many links is a skewed join that Spark splits, never a group collected into one task.
Tables between steps are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import store
from tidemark.sources.scratch import remove

#: Far above what the logarithmic number of steps can reach; passing it means an error.
MAX_STEPS = 100


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``: long); the root is the component's smallest node and is listed too."""
    plain = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    current, path = store(plain, "links")
    seen = None
    for _ in range(MAX_STEPS):
        mark = current.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).collect()[0]
        if mark == seen:
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
        seen = mark
        (current, path), before = store(_small_star(_large_star(current)), "links"), path
        remove(edges.sparkSession, before)
    raise RuntimeError("components did not settle")
