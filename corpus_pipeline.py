"""A training corpus from ``documents``: rules, toxicity, near-duplicates, mixing, packing.

Each stage gets what its predecessor kept, as a Parquet table, and returns the columns of
``documents``; the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import mixing, packing, quality, simhash, toxicity
from tidemark.llm._shared import store, table
from tidemark.sources.scratch import remove, temporary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go."""
    return quality.keep(docs)


def toxicity_chain(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go; it is trained on those of ``labels`` that are here."""
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose sets of 5-word shingles are linked by a similarity of 0.8 or more."""
    return simhash.deduplicate(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come to their target weights, in training order; a document comes once for each epoch."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 1024 tokens, one row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity_chain", toxicity_chain),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mixing", source_mixing),
    ("packing", pack),
]

#: A trained classifier and XXH64 shingles have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; what a stage has written goes when the next one is through, but for its result."""
    docs, held = table(spark, sf_dir, "documents", spread=True), None
    for name, stage in STAGES[:-1]:
        with temporary(spark) as keep:
            docs, path = store(stage(spark, docs, sf_dir), f"stage-{name}")
            keep(path)
        if held:
            remove(spark, held)
        held = path
    return STAGES[-1][1](spark, docs, sf_dir)
