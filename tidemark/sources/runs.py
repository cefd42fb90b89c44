"""Sorted runs: their statistics, which of them a query needs, and how they overlap."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import asdict, dataclass
from itertools import chain
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bounds import Bound


@dataclass(frozen=True)
class Run:
    """One sorted file of versions, as the manifest lists it. ``seq`` is the commit that wrote it."""

    id: str
    path: str
    level: int
    seq: int
    min_key: tuple
    max_key: tuple
    min_ts: int
    max_ts: int
    rows: int
    bytes: int
    has_tombstones: bool

    def to_json(self) -> dict:
        return asdict(self) | {"min_key": encode_key(self.min_key), "max_key": encode_key(self.max_key)}

    @classmethod
    def from_json(cls, x: dict) -> Run:
        return cls(**(x | {"min_key": decode_key(x["min_key"]), "max_key": decode_key(x["max_key"])}))

    def overlaps(self, other: Run) -> bool:
        return self.min_key <= other.max_key and other.min_key <= self.max_key


def encode_key(key: Sequence) -> list:
    return [{"hex": bytes(v).hex()} if isinstance(v, (bytes, bytearray)) else v for v in key]


def decode_key(key: Sequence) -> tuple:
    return tuple(bytes.fromhex(v["hex"]) if isinstance(v, dict) else v for v in key)


def prune(runs: Iterable[Run], lower: Bound, upper: Bound, read_ts: int | None = None) -> list[Run]:
    """The runs that can hold a key in the range at ``read_ts``. Ends may be shorter than the key."""
    kept = []
    for r in runs:
        low = lower.key if isinstance(lower.key, (tuple, list)) else (lower.key,)
        high = upper.key if isinstance(upper.key, (tuple, list)) else (upper.key,)
        if not lower.unbounded and r.max_key[: len(low)] < tuple(low):
            continue
        if not lower.unbounded and not lower.closed and r.max_key[: len(low)] == tuple(low):
            continue
        if not upper.unbounded and r.min_key[: len(high)] > tuple(high):
            continue
        if not upper.unbounded and not upper.closed and r.min_key[: len(high)] == tuple(high):
            continue
        if read_ts is not None and r.min_ts > read_ts:
            continue
        kept.append(r)
    return kept


def overlapping(runs: Iterable[Run], others: Iterable[Run]) -> list[Run]:
    """Those of ``others`` whose key range meets the range of all ``runs`` together."""
    runs = list(runs)
    if not runs:
        return []
    low, high = min(r.min_key for r in runs), max(r.max_key for r in runs)
    return [r for r in others if r.min_key <= high and low <= r.max_key]


def run_stats(df: DataFrame, run: Column, key: str, ts: str) -> DataFrame:
    """Per run: rows, smallest and largest key and version."""
    return df.groupBy(run.alias("run_id")).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(key).alias("min_key"),
        F.max(key).alias("max_key"),
        F.min(ts).alias("min_ts"),
        F.max(ts).alias("max_ts"),
    )


def prune_stats(stats: DataFrame, low: Any, high: Any) -> DataFrame:
    """Runs whose range meets [low, high]."""
    return stats.where((F.col("max_key") >= low) & (F.col("min_key") <= high))


@dataclass
class _Block:
    """Neighbours in the order of (smallest key, run): the first of them, the furthest that they reach, their number."""

    key: Any
    run: Any
    reach: Any
    rows: int


def _order(value: Any) -> tuple:
    """Spark's order of values: NaN is the largest."""
    return (True, None) if value != value else (False, value)


def _blocks(stats: DataFrame, cells: int, least: int) -> list[_Block]:
    """At most ``cells`` blocks of about equal size, of ``least`` rows or more (but for the last), in order."""
    first = F.min(F.struct("min_key", "run_id")).alias("first")
    cells = min(cells, stats.count() // least + 1)
    dealt = stats.repartitionByRange(cells, "min_key", "run_id") if cells > 1 else stats
    found = dealt.groupBy(*([F.spark_partition_id()] if cells > 1 else [])).agg(first, F.max("max_key").alias("reach"), F.count(F.lit(1)).alias("n"))
    blocks: list[_Block] = []
    for row in sorted(found.where("n > 0").collect(), key=lambda r: tuple(map(_order, r["first"]))):
        if blocks and blocks[-1].rows < least:
            last = blocks[-1]
            blocks[-1] = _Block(last.key, last.run, max(last.reach, row["reach"], key=_order), last.rows + row["n"])
        else:
            blocks.append(_Block(*row["first"], row["reach"], row["n"]))
    return blocks


def overlap_pairs(stats: DataFrame, cells: int = 256, least: int = 512, task: int = 4_000_000) -> DataFrame:
    """Pairs of runs (a < b) with overlapping key ranges, by an equi-join on pairs of blocks.

    Of two that overlap, the range of the one that begins first holds the beginning of the other. In the order of
    (smallest key, run) a run therefore overlaps with a stretch of those after it. That order is cut into blocks:
    a range goes with its own block to each that it reaches, a beginning with each block that reaches its own, so a pair
    meets once. Blocks part runs with equal smallest keys too; the join's tasks are so many that each compares some
    ``task`` pairs, however little the rows weigh that they come from.
    """
    held = stats.select("run_id", "min_key", "max_key").where(" AND ".join(f"{c} IS NOT NULL" for c in ("run_id", "min_key", "max_key")))
    blocks = _blocks(held, cells, least)
    ends = [sum(_order(b.key) <= _order(x.reach) for b in blocks) - 1 for x in blocks]  # the last block that some run of x reaches
    pairs = sum(x.rows * sum(b.rows for b in blocks[i : ends[i] + 1]) for i, x in enumerate(blocks))
    index = lambda values, test: F.size(F.filter(F.array(*values), test)) - 1 if values else F.lit(0)
    lit = lambda value, column: F.lit(value).cast(held.schema[column].dataType)
    firsts = [F.struct(lit(b.key, "min_key").alias("min_key"), lit(b.run, "run_id").alias("run_id")) for b in blocks]
    own = index(firsts, lambda e: e <= F.struct("min_key", "run_id"))
    last = index([lit(b.key, "min_key") for b in blocks], lambda e: e <= F.col("max_key"))
    reaching = F.filter(F.sequence(F.lit(0), F.col("own")), lambda b: F.get(F.array(*map(F.lit, ends or [0])), b) >= F.col("own"))
    placed = held.withColumn("own", own)
    ranges = placed.select(F.col("run_id").alias("x"), F.col("min_key").alias("low"), F.col("max_key").alias("high"), F.col("own").alias("from"), F.explode(F.sequence("own", F.greatest("own", last))).alias("to"))
    begins = placed.select(F.col("run_id").alias("y"), F.col("min_key").alias("begin"), F.col("own").alias("to"), F.explode(reaching).alias("from"))
    tasks = min(10_000, pairs // task + 1)
    dealt = lambda df: df.repartition(tasks, "from", "to")
    before = (F.col("low") < F.col("begin")) | ((F.col("low") == F.col("begin")) & (F.col("x") < F.col("y")))
    found = dealt(ranges).join(dealt(begins).hint("merge"), ["from", "to"]).where(before & (F.col("begin") <= F.col("high")))
    return found.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def _bits(key: str, hashes: int, bits: int) -> Column:
    """The bits that a key sets: parts of its digest."""
    digest = F.md5(F.col(key).cast("string").cast("binary"))
    return F.array(*(F.pmod(F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long"), F.lit(bits)) for k in range(hashes)))


def bloom(df: DataFrame, run: Column, key: str, bits: int = 1024, hashes: int = 2) -> DataFrame:
    """A Bloom filter for every run: ``run_id, word, mask``, words of 32 bits, combined before the shuffle."""
    set_in = df.select(run.alias("run_id"), F.explode(_bits(key, hashes, bits)).alias("bit"))
    return set_in.groupBy("run_id", F.floor(F.col("bit") / 32).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(bit % 32 AS INT))")).alias("mask"))


def _whole(filters: DataFrame, bits: int) -> DataFrame:
    """One row for every run and bit set in its filter, with the whole filter as an array of longs."""
    half = lambda n: F.coalesce(F.max(F.when(F.col("word") == n, F.col("mask"))), F.lit(0).cast("long"))
    longs = [half(n).bitwiseOR(F.shiftleft(half(n + 1), 32)) for n in range(0, (bits + 31) // 32, 2)]
    wide = filters.groupBy("run_id").agg(F.array(*longs).alias("filter"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bits - 1).cast("long"))).alias("bit")
    return wide.select("run_id", "filter", every).where(F.get("filter", _long("bit")).bitwiseAND(_place("bit")) != 0)


def _long(bit: str) -> Column:
    """Which long of a filter a bit is in."""
    return F.shiftright(bit, 6).cast("int")


def _place(bit: str) -> Column:
    """The bit's place in that long."""
    return F.expr(f"shiftleft(1L, CAST({bit} & 63 AS INT))")


def may_hold(filters: DataFrame, keys: DataFrame, key: str, bits: int = 1024, hashes: int = 2) -> DataFrame:
    """``run_id`` and key of the runs that may hold it: all of its bits are set. No run that does is missing.

    A key meets the runs that have its first bit, once each, and its other bits are looked up in the run's
    whole filter there: what is joined is neither grouped nor shuffled again.
    """
    asked = keys.select(key).distinct().withColumn("asked", _bits(key, hashes, bits))
    asked = asked.select(key, *(F.get("asked", F.lit(k)).alias(f"_bit{k}") for k in range(hashes)))
    others = [(_long(f"_bit{k}").alias(f"_long{k}"), _place(f"_bit{k}").alias(f"_place{k}")) for k in range(1, hashes)]
    asked = asked.select(key, F.col("_bit0").alias("bit"), *chain.from_iterable(others))
    found = _whole(filters, bits).join(asked, "bit")
    for k in range(1, hashes):
        found = found.where(F.get("filter", F.col(f"_long{k}")).bitwiseAND(F.col(f"_place{k}")) != 0)
    return found.select("run_id", key)
