"""The queries of this subpackage and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, extract, licenses, mixing, packing, quality, shards, simhash, topk, toxicity
from tidemark.llm._shared import table
from tidemark.llm.sql import SQL

__all__ = ["QUERIES", "SQL"]

Query = Callable[[SparkSession, str], DataFrame]


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.report(table(spark, sf_dir, "embeddings"))


def op2_preference_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.contrast_pairs(table(spark, sf_dir, "conversations"))
    masks = {c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("chosen_mask", "rejected_mask")}
    return pairs.withColumns(masks)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents", spread=True))


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(table(spark, sf_dir, "pages", spread=True))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents", spread=True))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(table(spark, sf_dir, "documents", spread=True))


def op7_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", spread=True)
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(table(spark, sf_dir, "documents", spread=True))


def op9_training_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.training_shards(table(spark, sf_dir, "documents", spread=True))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents", spread=True)).withColumns({"score": F.round("score", 6), "line": F.col("line").cast("string")})


QUERIES: dict[str, Query] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_preference_formatting": op2_preference_formatting,
    "op3_packing": op3_packing,
    "op4_html_extraction": op4_html_extraction,
    "op5_quality_rules": op5_quality_rules,
    "op6_source_mixing": op6_source_mixing,
    "op7_toxicity_chain": op7_toxicity_chain,
    "op8_simhash_near_duplicates": op8_simhash_near_duplicates,
    "op9_training_shards": op9_training_shards,
    "op10_license_scan": op10_license_scan,
}
