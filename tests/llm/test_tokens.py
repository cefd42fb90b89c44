"""Token streams, packing and shards: exact round trips."""

import math
import random
import shutil
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import packing, shards
from tidemark.llm.tokens import _PLAIN, encoder, vocabulary_path

TEXTS = [None, "", " ", "a", "Hello, world! It's 2024.\n\n  x", "日本語 текст 🎉 <|endoftext|>", "word " * 3000, "a" * 5000, "éàü ß\xa0\x0b", "one two"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(9, "one two", "clash"), (None, "no id", "clash")]
    return spark.createDataFrame(rows, "doc_id long, text string, part string").repartition(4).cache()


OWN = Tokenizer.from_file(vocabulary_path())


def ids_of(text):
    return OWN.encode(text or "", add_special_tokens=False).ids + [0]


def test_both_encoders_agree_on_plain_text():
    e = encoder(vocabulary_path())
    chars = [chr(c) for c in range(0x300) if _PLAIN.fullmatch(chr(c))]
    assert len(chars) > 500 and not _PLAIN.fullmatch(" ") and not _PLAIN.fullmatch("語")
    rnd = random.Random(1)
    cases = [s for c in chars for s in (c, f"a{c}b", f" {c} ", c + c + "1", f".{c}\n")]
    cases += ["".join(rnd.choice(chars if rnd.random() < 0.5 else " \n\t'stredlv 12ab.!\xa0") for _ in range(rnd.randint(1, 40))) for _ in range(3000)]
    for s in cases:
        assert e.fast.encode_ordinary(s) == e.slow.encode(s, add_special_tokens=False).ids, repr(s)


@pytest.mark.parametrize("length", [1, 7, 64, 1024])
def test_pieces(docs, length):
    stream = packing.tokenize(docs)
    rows = packing.pieces(stream, length).collect()
    by_place = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in by_place:  # gapless, in order, within the windows
        assert r.sequence_id * length + r.offset == at and 0 < r.length <= length - r.offset
        at += r.length
    assert at == stream.tokens == sum(len(ids_of(r.text)) for r in docs.collect())
    for i, t in enumerate(TEXTS):
        ids = np.array(ids_of(t), dtype="<u4")
        mine = [r for r in by_place if r.doc_id == i]
        assert all(r.doc_tokens == len(ids) for r in mine)
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
        assert sum(r.length for r in mine) == len(ids) * (2 if i == 9 else 1)


def test_sequences_are_the_stream(docs):
    stream = packing.tokenize(docs)
    found = {r.sequence_id: np.frombuffer(r.ids, stream.dtype) for r in packing.sequences(stream, 50).collect()}
    assert sorted(found) == list(range(stream.sequences(50)))
    assert [len(found[k]) for k in sorted(found)][:-1] == [50] * (len(found) - 1)
    whole = np.concatenate([found[k] for k in sorted(found)])
    crc = {(r.sequence_id, r.offset): r for r in packing.pieces(stream, 50).collect()}
    for (s, o), r in crc.items():
        assert zlib.crc32(whole[s * 50 + o : s * 50 + o + r.length].astype("<u4").tobytes()) == r.ids_crc32


def test_empty_tables(docs):
    assert packing.pack(docs.limit(0)).count() == 0
    assert packing.sequences(packing.tokenize(docs.limit(0))).count() == 0
    assert shards.training_shards(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    p = shards.Permutation(n)
    x = p(range(n))
    assert sorted(x.tolist()) == list(range(n)) and (p.inverse(x) == np.arange(n)).all()
    if n >= 1000:
        assert (shards.Permutation(n, key=1)(range(n)) != x).mean() > 0.9
        assert abs(np.corrcoef(np.arange(n), x)[0, 1]) < 0.2


def feistel(n, key, number):
    """Where a number of 0..n-1 goes, in plain integers, as the module describes it."""
    bits = max(1, math.ceil(math.log2(n) / 2)) if n > 1 else 1
    mask, word = (1 << bits) - 1, (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & word
        x = (x ^ x >> 27) * 0x94D049BB133111EB & word
        return x ^ x >> 31

    while True:
        left, right = number >> bits, number & mask
        for r in range(6):
            left, right = right, left ^ (mix(right ^ mix((key + (r + 1) * 0x9E3779B97F4A7C15) & word)) & mask)
        number = left << bits | right
        if number < n:
            return number


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000])
def test_permutation_is_the_feistel_network(n):
    for key in (shards.KEY, 0, 2**64 - 1):
        assert shards.Permutation(n, key)(range(n)).tolist() == [feistel(n, key, k) for k in range(n)]


def test_query_writes_every_document_to_its_slots(spark, tmp_path):
    """The whole table: read back from disk without the package, every shard holds the stream's windows where the permutation says."""
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    index = shards.training_shards(table, f"file://{tmp_path}/s", shard_rows=100).collect()
    stream = [i for r in table.collect() for i in ids_of(r.text)]  # one file: its rows in order
    n = -(-len(stream) // 1024)
    data = b"".join((tmp_path / "s" / f"shard-{k:08d}.bin").read_bytes() for k in range(-(-n // 100)))
    held = np.frombuffer(data, "<u2").reshape(n, 1024)
    for k in range(n):
        ids = stream[1024 * k : 1024 * (k + 1)]
        assert held[feistel(n, shards.KEY, k)].tolist() == ids + [shards.PAD] * (1024 - len(ids))
    assert {(r.slot, r.sequence_id, r.n_tokens) for r in index} == {(feistel(n, shards.KEY, k), k, min(1024, len(stream) - 1024 * k)) for k in range(n)}


def test_a_lost_fragment_is_a_gap(docs, tmp_path):
    stream = packing.tokenize(docs)
    stream.table = stream.table.where("doc_id = 6 OR doc_id = 7")  # the others' places stay empty
    with pytest.raises(Exception, match="gaps"):
        shards.write(stream, f"file://{tmp_path}/gaps", length=16).collect()


def test_other_splits_resume_and_other_file_systems_are_refused_early(spark, tmp_path):
    path = f"{tmp_path}/docs"
    spark.range(300).selectExpr("id AS doc_id", "concat('some words ', id) AS text").repartition(2).write.option("parquet.block.size", 1024).parquet(path)
    first = shards.training_shards(spark.read.parquet(path), f"file://{tmp_path}/r", length=16).collect()
    limit = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        again = shards.training_shards(spark.read.parquet(path), f"file://{tmp_path}/r", length=16).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", limit)
    assert sorted(first) == sorted(again)
    assert [shards.plain_uri(u) for u in ("s3a://bucket/x", "s3://b", "file:///x")] == ["s3://bucket/x", "s3://b", "file:///x"]
    with pytest.raises(ValueError, match="wasbs"):
        shards.training_shards(None, "wasbs://x@y/z")


def test_shards_round_trip_and_resume(docs, tmp_path):
    stream = packing.tokenize(docs)
    length, rows = 16, 37
    want = {r.sequence_id: r.ids for r in packing.sequences(stream, length).collect()}
    out = f"file://{tmp_path}/shards"
    index = shards.write(stream, out, length=length, shard_rows=rows).toPandas().sort_values("slot").reset_index(drop=True)
    assert index.slot.tolist() == list(range(len(want))) and sorted(index.sequence_id) == sorted(want)
    got = shards.read_slots(out, 0, 10**9)
    for r in index.itertuples():
        assert got[r.slot, : r.n_tokens].tobytes() == want[r.sequence_id]
        assert r.byte_offset == (r.slot % rows) * length * 2 and r.shard == r.slot // rows
    assert (shards.read_slots(out, 30, 50) == got[30:80]).all() and len(shards.read_slots(out, 10**6, 5)) == 0
    (tmp_path / "shards" / "shard-00000001.bin").unlink()
    (tmp_path / "shards" / "_writing-00000001-7").write_bytes(b"lost")
    again = shards.write(stream, out, length=length, shard_rows=rows).toPandas().sort_values("slot").reset_index(drop=True)
    assert not list((tmp_path / "shards").glob("_writing*"))
    assert again.equals(index) and (shards.read_slots(out, 0, 10**9) == got).all()
    with pytest.raises(ValueError):
        shards.write(stream, out, length=length, shard_rows=rows, key=1)
    shutil.rmtree(tmp_path / "shards")


def test_added_tokens_keep_their_ids():
    e, own = encoder(vocabulary_path()), OWN
    for t in ("a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é", "<|endoftext| >", "語 <|endoftext|>", "a < | b"):
        assert e(t).tolist() == own.encode(t, add_special_tokens=False).ids, t
    assert e("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
