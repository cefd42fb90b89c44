"""The stream of packing follows the order in which its input was written."""

import random

from pyspark.sql import functions as F

from tidemark.llm import packing


def in_stream(stream):
    rows = packing.pieces(stream, 64).where("start = 0").orderBy("sequence_id", "offset").collect()
    return [r.doc_id for r in rows]


def test_files_of_unequal_size_keep_their_order(spark, tmp_path):
    rnd, n = random.Random(1), 600
    rows = [(k, " ".join(rnd.choice("abcdefgh") for _ in range(rnd.choice((1, 5, 400 if k % 90 < 20 else 30))))) for k in range(n)]
    out = str(tmp_path / "sorted")
    spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(12, "doc_id").sortWithinPartitions("doc_id").write.option("maxRecordsPerFile", 20).parquet(out)
    read = spark.read.parquet(out)
    assert [r.doc_id for r in read.collect()] != list(range(n))  # a scan deals files by size
    assert in_stream(packing.tokenize(read)) == list(range(n))
    odd = read.where("doc_id % 2 = 1").select("text", "doc_id", F.lit("x").alias("file"), F.lit(1).alias("_metadata"))
    assert in_stream(packing.tokenize(odd)) == list(range(1, n, 2))
    back = read.orderBy(F.desc("doc_id"))  # no plain scan: the order is the frame's own
    assert in_stream(packing.tokenize(back)) == list(range(n))[::-1]
