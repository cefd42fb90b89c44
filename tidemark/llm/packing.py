"""Packing by concatenate and cut.

All documents, each followed by an end token, make up one stream, which is cut into windows of
``length`` tokens; only the last window can be shorter. Two passes of prefix sums place them:
the first tokenizes every part and notes each document's place in it, part totals (one number per
part) summed on the driver give each part's place in the stream, and the second pass cuts. Parts
are the blocks of the input's files in the order in which they were written, because a scan deals
files by size; where the input is no plain scan of files, they are its partitions. Nothing is shuffled, so neither hot sources nor long documents matter; windows
that cross parts are put together from boundary records.

The first pass writes its tokens as a table into the shared folder: the text is tokenized once, and
a lost executor cannot change the order that the offsets stand for.

Defined results for odd input: a null or empty text is the end token alone; documents of any length
are cut; repeated rows and null ids are documents of their own; an empty table gives no pieces;
further input columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import map_arrow
from tidemark.llm.tokens import encoder, vocabulary_path
from tidemark.sources.scratch import shared_path

LENGTH = 1024
END = 0
#: Rows handled at once in a Python worker.
ROWS = 256

TOKENS = "part long, file string, block long, doc_id long, at long, n long, ids binary"
#: Plan nodes that leave the rows of a scan in their order.
IN_ORDER = {"Project", "Filter", "SubqueryAlias", "View"}
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, boundary boolean"


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[str | None, int, pa.RecordBatch]]:
    """Runs of rows of one block of a file."""
    files, blocks = batch.column("file").to_pylist(), batch.column("block").to_pylist()
    at = 0
    for k in range(1, len(files) + 1):
        if k == len(files) or (files[k], blocks[k]) != (files[at], blocks[at]):
            yield files[at], blocks[at], batch.slice(at, k - at)
            at = k


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encode, of, at = encoder(path), None, 0
    for file, block, batch in (x for b in _slices(batches) for x in _blocks(b)):
        if of != (file, block):
            of, at = (file, block), 0
        part = xxhash.xxh64_intdigest(f"{file}\x00{block}") >> 1
        if file is None:
            part = block = TaskContext.get().partitionId()
        texts = batch.column("text").to_pylist()
        ids = [np.append(encode(t), np.array([end], encode.dtype)) for t in (t or "" for t in texts)]
        n = np.array([len(x) for x in ids], dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(n), part, np.int64)), pa.array([file] * len(n), pa.string()), pa.array(np.full(len(n), block, np.int64)), batch.column("doc_id"),
             pa.array(at + np.cumsum(n) - n), pa.array(n), pa.array([x.tobytes() for x in ids], pa.binary())],
            names=["part", "file", "block", "doc_id", "at", "n", "ids"],
        )
        at += int(n.sum())


def _scans_files(docs: DataFrame) -> bool:
    """Whether the rows are those of a scan of files, in its order."""
    node = docs._jdf.queryExecution().analyzed()
    while node.nodeName() in IN_ORDER:
        node = node.children().head()
    return node.children().isEmpty() and "_metadata" in {c.name() for c in _items(node.metadataOutput())}


def _items(found) -> Iterator:
    return (found.apply(k) for k in range(found.size()))


def written(file: str | None, block: int) -> tuple:
    """Sorts parts in the order in which one write made them."""
    folder, _, name = (file or "").rpartition("/")
    number = re.match(r"part-(\d+)", name)
    return folder, int(number[1]) if number else -1, name, block


class Stream:
    """Tokens of all documents with every part's place in the stream; ``order`` has what the parts are sorted by."""

    def __init__(self, table: DataFrame, path: str, totals: dict[int, int], order: dict[int, tuple], dtype: np.dtype):
        self.table, self.path, self.dtype = table, path, dtype
        parts, bases, at = sorted(totals), {}, 0
        for p in sorted(parts, key=lambda p: order[p]):
            bases[p] = at
            at += totals[p]
        self.parts = np.array(parts, dtype=np.int64)
        self.totals = np.array([totals[p] for p in parts], dtype=np.int64)
        self.bases = np.array([bases[p] for p in parts], dtype=np.int64)
        self.tokens = at

    def sequences(self, length: int = LENGTH) -> int:
        return -(-self.tokens // length)


def tokenize(docs: DataFrame, vocabulary: str | None = None, end: int = END) -> Stream:
    """First pass. What comes to the driver is one total for each part."""
    path = vocabulary or vocabulary_path()
    if _scans_files(docs):
        file, block = docs.metadataColumn("_metadata")["file_path"], docs.metadataColumn("_metadata")["file_block_start"]
    else:
        file, block = F.lit(None).cast("string"), F.lit(0).cast("long")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), file.alias("file"), block.alias("block"))
    out = shared_path(docs.sparkSession, "tokens")
    made = map_arrow(plain, functools.partial(_tokenize, path=path, end=end), TOKENS)
    made.write.options(**{"compression": "zstd", "parquet.compression.codec.zstd.level": "9"}).parquet(out)
    table = docs.sparkSession.read.schema(TOKENS).parquet(out)
    totals = table.groupBy("part", "file", "block").agg(F.max(F.col("at") + F.col("n")).alias("n")).collect()
    return Stream(table, out, {r["part"]: r["n"] for r in totals}, {r["part"]: written(r["file"], r["block"]) for r in totals}, encoder(path).dtype)


def _cut(batch: pa.RecordBatch, bases: np.ndarray, parts: np.ndarray, length: int):
    """Where the windows cut a batch's documents: row, window, start and end in the stream, and the document's start."""
    place = np.searchsorted(parts, batch.column("part").to_numpy())
    begin = bases[place] + batch.column("at").to_numpy()
    n = batch.column("n").to_numpy()
    first, last = begin // length, (begin + n - 1) // length
    count = last - first + 1
    row = np.repeat(np.arange(len(n)), count)
    window = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    a = np.maximum(begin[row], window * length)
    b = np.minimum(begin[row] + n[row], (window + 1) * length)
    return row, window, a, b, begin[row], place[row]


def _pieces(batches, bases, totals, parts, length, dtype):
    for batch in _slices(batches):
        row, window, a, b, begin, place = _cut(batch, bases, parts, length)
        ids = batch.column("ids")
        wide = {}
        crc = np.empty(len(row), np.int64)
        for k, r in enumerate(row.tolist()):
            if r not in wide:
                wide = {r: np.frombuffer(ids[r].as_buffer(), dtype).astype("<u4")}
            crc[k] = zlib.crc32(wide[r][a[k] - begin[k] : b[k] - begin[k]])
        crosses = (window * length < bases[place]) | ((window + 1) * length > bases[place] + totals[place])
        take = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(take), pa.array(a - begin), pa.array(b - a), pa.array(crc), batch.column("n").take(take), pa.array(window), pa.array(a - window * length), pa.array(crosses)],
            names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "boundary"],
        )


def pieces(stream: Stream, length: int = LENGTH) -> DataFrame:
    """Second pass: one row for each part of a document that lies in one sequence."""
    work = functools.partial(_pieces, bases=stream.bases, totals=stream.totals, parts=stream.parts, length=length, dtype=stream.dtype)
    return map_arrow(stream.table, work, PIECES)


def fragments_of(batch: pa.RecordBatch, bases, parts, length: int, dtype: np.dtype):
    """The windows that a batch's documents fill, whole or in part: window, offset, ids. Neighbouring documents are joined."""
    row, window, a, b, begin, _ = _cut(batch, bases, parts, length)
    ids = batch.column("ids")
    held: list[np.ndarray] = []
    at = end = -1
    for k in range(len(row)):
        if held and (a[k] != end or window[k] != at // length):
            yield at // length, at % length, np.concatenate(held)
            held = []
        if not held:
            at = int(a[k])
        held.append(np.frombuffer(ids[int(row[k])].as_buffer(), dtype)[a[k] - begin[k] : b[k] - begin[k]])
        end = int(b[k])
    if held:
        yield at // length, at % length, np.concatenate(held)


def _fragments(batches, bases, parts, length, dtype):
    for batch in _slices(batches):
        found = list(fragments_of(batch, bases, parts, length, dtype))
        yield pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2].tobytes() for x in found], pa.binary()), pa.array([len(x[2]) for x in found], pa.int64())],
            names=["sequence_id", "offset", "ids", "n"],
        )


def sequences(stream: Stream, length: int = LENGTH) -> DataFrame:
    """The packed sequences, ``sequence_id, ids`` (little-endian). Only windows in several fragments are shuffled."""
    work = functools.partial(_fragments, bases=stream.bases, parts=stream.parts, length=length, dtype=stream.dtype)
    found = map_arrow(stream.table, work, "sequence_id long, offset long, ids binary, n long")
    whole = found.where(F.col("n") == length).select("sequence_id", "ids")
    joined = (
        found.where(F.col("n") < length)
        .groupBy("sequence_id")
        .agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select("sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    )
    return whole.unionByName(joined)


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END) -> DataFrame:
    return pieces(tokenize(docs, vocabulary, end), length)
