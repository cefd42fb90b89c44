"""Training-order materialisation into fixed-stride binary shards.

Packed sequences (see :mod:`tidemark.llm.packing`) get their place in the training order from a
keyed Feistel permutation of 0..n-1: the network permutes the next power of four, and numbers that
land at or beyond n walk on along their cycle until they are below n. The permutation needs no
table, no shuffle and no draw; either direction is computed for any number at any time.

Shard k holds the slots from k * shard_rows on, each in ``length`` ids of fixed width, so that a
reader finds slot s at byte (s mod shard_rows) * stride of file s // shard_rows and reads on in
order. Sequences go to their shard's partition directly; a task fills one shard in memory (its
size is a parameter) and publishes the file by renaming, so a repeated or lost task leaves either
the whole file or none. A later run with the same input and key skips the shards that are there.

Defined results for odd input: the last sequence is padded with ``pad`` and its length is in the
index; a shard whose sequences are not whole is an error; an empty table gives no shards and an empty index; null and empty texts, long texts and
repeated rows are treated as in packing.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import map_arrow, materialize
from tidemark.llm.packing import LENGTH, Stream, fragments_of, tokenize
from tidemark.sources.scratch import shared_path

SHARD_ROWS = 1 << 14
ROUNDS = 6
KEY = 0x5EED
PAD = 0
#: Sequences of one shard that a map task compresses together.
BLOCK = 128

INDEX = "slot long, sequence_id long, shard int, byte_offset long, n_tokens long, ids_crc32 long"


class Permutation:
    """A keyed permutation of 0..n-1."""

    def __init__(self, n: int, key: int = KEY, rounds: int = ROUNDS):
        self.n, self.half = n, max(1, -(-max(n - 1, 1).bit_length() // 2))
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [self._mix(np.array([(key + (r + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1)], np.uint64))[0] for r in range(rounds)]

    @staticmethod
    def _mix(x: np.ndarray) -> np.ndarray:
        """A 64-bit finalizer (the constants are those of SplitMix64)."""
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def _network(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                left, right = right ^ (self._mix(left ^ k) & self.mask), left
            else:
                left, right = right, left ^ (self._mix(right ^ k) & self.mask)
        return (left << np.uint64(self.half)) | right

    def _walk(self, numbers, back: bool) -> np.ndarray:
        x = np.array(numbers, dtype=np.uint64)
        todo = np.arange(len(x))
        while len(todo):
            x[todo] = self._network(x[todo], back)
            todo = todo[x[todo] >= self.n]
        return x.astype(np.int64)

    def __call__(self, numbers) -> np.ndarray:
        return self._walk(numbers, False)

    def inverse(self, slots) -> np.ndarray:
        return self._walk(slots, True)


def _file(out: str, shard: int) -> str:
    return f"{out}/shard-{shard:08d}.bin"


def _deal(batches, stream_parts, length, dtype, n, key, shard_rows, done) -> Iterator[pa.RecordBatch]:
    """Fragments of sequences as compressed blocks, each of one shard."""
    permutation, packer = Permutation(n, key), zstandard.ZstdCompressor(3)
    bases, parts = stream_parts
    held: dict[int, list] = {}

    def block(shard: int):
        slots, ids, offsets, data = zip(*held.pop(shard), strict=True)
        sizes = [len(x) // dtype.itemsize for x in data]
        head = np.array([slots, ids, offsets, sizes], dtype="<i8")
        return shard, head.tobytes(), packer.compress(b"".join(data))

    def batch(blocks):
        return pa.RecordBatch.from_arrays(
            [pa.array([x[0] for x in blocks], pa.int32()), pa.array([x[1] for x in blocks], pa.binary()), pa.array([x[2] for x in blocks], pa.binary())],
            names=["shard", "head", "data"],
        )

    for rows in batches:
        found = list(fragments_of(rows, bases, parts, length, dtype))
        slots = permutation([x[0] for x in found])
        ready = []
        for (sequence, offset, ids), slot in zip(found, slots.tolist(), strict=True):
            shard = slot // shard_rows
            if shard in done:
                continue
            held.setdefault(shard, []).append((slot, sequence, offset, ids.tobytes()))
            if len(held[shard]) == BLOCK:
                ready.append(block(shard))
        if ready:
            yield batch(ready)
        while sum(map(len, held.values())) > 64 * BLOCK:  # with very many shards, the fullest go first
            yield batch([block(max(held, key=lambda k: len(held[k])))])
    if held:
        yield batch([block(k) for k in list(held)])


def plain_uri(out: str) -> str:
    """The URI with the scheme that Arrow has for it."""
    return re.sub(r"^s3[an]://", "s3://", out)


def file_system(out: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, and the path in it."""
    try:
        return pyarrow.fs.FileSystem.from_uri(plain_uri(out))
    except pa.ArrowInvalid as e:
        raise ValueError(f"shards cannot be written to {out}: {e}") from None


def _write(batches, out, length, dtype, tokens, n, shard_rows, pad) -> Iterator[pa.RecordBatch]:
    """Fill one shard after the other (blocks come sorted by shard), publish it, and emit its index."""
    from pyspark import TaskContext

    fs, root = file_system(out)
    unpacker = zstandard.ZstdDecompressor()
    shard, rows, sequence, filled = -1, None, None, None

    def publish():
        first = shard * shard_rows
        count = min(shard_rows, n - first)
        if (filled[:count] != np.minimum(length, tokens - sequence[:count] * length)).any():
            raise RuntimeError(f"shard {shard} has gaps")
        task = TaskContext.get().taskAttemptId()
        name, temporary = _file(root, shard), f"{root}/_writing-{shard:08d}-{task}"
        with fs.open_output_stream(temporary) as to:
            to.write(rows[:count].tobytes())
        fs.move(temporary, name)
        return _index(np.arange(first, first + count), sequence[:count], filled[:count], rows, shard, shard_rows)

    for batch in batches:
        for k, head, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "head", "data")), strict=True):
            if k != shard:
                if rows is not None:
                    yield publish()
                shard = k
                rows = np.full((shard_rows, length), pad, dtype)
                sequence, filled = np.zeros(shard_rows, np.int64), np.zeros(shard_rows, np.int64)
            ids, at = np.frombuffer(unpacker.decompress(data), dtype), 0
            for slot, number, offset, size in np.frombuffer(head, "<i8").reshape(4, -1).T.tolist():
                place = slot - shard * shard_rows
                rows[place, offset : offset + size] = ids[at : at + size]
                sequence[place], at = number, at + size
                filled[place] += size
    if rows is not None:
        yield publish()


def _index(slots, sequence, filled, rows, shard, shard_rows) -> pa.RecordBatch:
    stride = rows.shape[1] * rows.dtype.itemsize
    crc = [zlib.crc32(rows[k, :size].astype("<u4")) for k, size in enumerate(filled.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(slots), pa.array(sequence), pa.array(np.full(len(slots), shard, np.int32)), pa.array((slots - shard * shard_rows) * stride), pa.array(filled), pa.array(crc, pa.int64())],
        names=["slot", "sequence_id", "shard", "byte_offset", "n_tokens", "ids_crc32"],
    )


def _reread(batches, out, length, dtype, tokens, n, key, shard_rows) -> Iterator[pa.RecordBatch]:
    """The index of shards that an earlier run has published."""
    fs, root = file_system(out)
    permutation = Permutation(n, key)
    for batch in batches:
        for shard in batch.column("id").to_pylist():
            with fs.open_input_file(_file(root, shard)) as file:
                rows = np.frombuffer(file.read(), dtype).reshape(-1, length)
            slots = np.arange(shard * shard_rows, shard * shard_rows + len(rows))
            sequence = permutation.inverse(slots)
            yield _index(slots, sequence, np.minimum(length, tokens - sequence * length), rows, shard, shard_rows)


def _digest(batches, bases, parts) -> Iterator[pa.RecordBatch]:
    """A checksum of the tokens and their places in the stream, however the input is split."""
    for batch in batches:
        begin = bases[np.searchsorted(parts, batch.column("part").to_numpy())] + batch.column("at").to_numpy()
        found = [xxhash.xxh3_64_intdigest(x.as_buffer(), b) >> 1 for x, b in zip(batch.column("ids"), begin.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["h"])


def read_slots(out: str, first: int, count: int) -> np.ndarray:
    """``count`` sequences of the training order from slot ``first`` on, as rows of ids."""
    fs, root = file_system(out)
    with fs.open_input_file(f"{root}/manifest.json") as file:
        m = json.loads(file.read())
    stride, dtype = m["length"] * np.dtype(m["dtype"]).itemsize, np.dtype(m["dtype"])
    got, end = [], min(first + count, m["sequences"])
    while first < end:
        shard, place = divmod(first, m["shard_rows"])
        rows = min(m["shard_rows"] - place, end - first)
        with fs.open_input_file(_file(root, shard)) as file:
            file.seek(place * stride)
            got.append(np.frombuffer(file.read(rows * stride), dtype).reshape(rows, m["length"]))
        first += rows
    return np.concatenate(got) if got else np.empty((0, m["length"]), dtype)


def write(stream: Stream, out: str, key: int = KEY, length: int = LENGTH, shard_rows: int = SHARD_ROWS, pad: int = PAD) -> DataFrame:
    """Write the shards of a token stream below ``out``; the index, one row per sequence.

    ``out`` is a URI that driver and executors share. A folder with another manifest is refused.
    """
    spark = stream.table.sparkSession
    n = stream.sequences(length)
    shards = -(-n // shard_rows)
    digests = map_arrow(stream.table.select("part", "at", "ids"), functools.partial(_digest, bases=stream.bases, parts=stream.parts), "h long")
    check = str(digests.agg(F.sum(F.col("h").cast("decimal(38,0)"))).collect()[0][0])
    manifest = {"sequences": n, "tokens": stream.tokens, "length": length, "dtype": stream.dtype.str, "shard_rows": shard_rows, "key": key, "pad": pad, "rounds": ROUNDS, "input": check}
    fs, root = file_system(out)
    fs.create_dir(root, recursive=True)
    there = fs.get_file_info(f"{root}/manifest.json")
    if there.type == pyarrow.fs.FileType.File:
        with fs.open_input_file(there.path) as file:
            if json.loads(file.read()) != manifest:
                raise ValueError(f"{out} holds the shards of another run")
    else:
        with fs.open_output_stream(there.path) as file:
            file.write(json.dumps(manifest).encode())
    names = {f.base_name for f in fs.get_file_info(pyarrow.fs.FileSelector(root))}
    done = {k for k in range(shards) if f"shard-{k:08d}.bin" in names}

    deal = functools.partial(_deal, stream_parts=(stream.bases, stream.parts), length=length, dtype=stream.dtype, n=n, key=key, shard_rows=shard_rows, done=done)
    fill = functools.partial(_write, out=out, length=length, dtype=stream.dtype, tokens=stream.tokens, n=n, shard_rows=shard_rows, pad=pad)
    again = functools.partial(_reread, out=out, length=length, dtype=stream.dtype, tokens=stream.tokens, n=n, key=key, shard_rows=shard_rows)
    blocks = map_arrow(stream.table, deal, "shard int, head binary, data binary")
    dealt = blocks.repartitionById(max(1, shards), F.col("shard")).sortWithinPartitions("shard")
    index = materialize(map_arrow(dealt, fill, INDEX), "shard-index")
    for left in fs.get_file_info(pyarrow.fs.FileSelector(root)):  # by tasks that were lost while they wrote
        if left.base_name.startswith("_writing-"):
            fs.delete_file(left.path)
    if not done:
        return index
    old = spark.createDataFrame([(k,) for k in sorted(done)], "id int").repartition(min(len(done), 1000))
    return index.unionByName(map_arrow(old, again, INDEX))


def training_shards(docs: DataFrame, out: str | None = None, vocabulary: str | None = None, **options) -> DataFrame:
    """Tokenize, pack, permute and write ``docs``; the index of all sequences."""
    if out:
        file_system(out)
    return write(tokenize(docs, vocabulary), out or shared_path(docs.sparkSession, "shards"), **options)
