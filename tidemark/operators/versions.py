"""Operators on versioned rows: pure functions from DataFrames to DataFrames, without actions.

A versioned table has key columns, a version number ``ts`` (larger is newer) and a tombstone flag.
Order of operations: limit the versions, choose the newest per key, and only then drop tombstones;
dropping them first would bring older versions back. Predicates on keys may go before the choice
(and into the scan), predicates on values only after it.

The newest version per key is ``row_number() = 1``: Spark cuts every key to one row per task before
the exchange (WindowGroupLimit), so a key with very many versions ships few of them.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.bounds import UNBOUNDED, equals, in_range


@dataclass(frozen=True)
class Versions:
    """Names of a versioned table's columns. ``ties`` order equal versions: the largest wins."""

    keys: tuple[str, ...]
    ts: str = "ts"
    tombstone: str = "is_tombstone"
    ties: tuple[str, ...] = ()

    @property
    def newest_first(self) -> list[Column]:
        return [F.col(c).desc() for c in (self.ts, *self.ties)]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row for each key: the first in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where(F.col("_rank") == 1).drop("_rank")


def visible(df: DataFrame, v: Versions, read_ts: int | None) -> DataFrame:
    """Versions up to ``read_ts`` (none: all)."""
    return df if read_ts is None else df.where(F.col(v.ts) <= F.lit(read_ts))


def newest(df: DataFrame, v: Versions, read_ts: int | None = None) -> DataFrame:
    """The newest visible version of every key, tombstones included."""
    return first_per_key(visible(df, v, read_ts), v.keys, v.newest_first)


def live(df: DataFrame, v: Versions) -> DataFrame:
    return df.where(~F.col(v.tombstone))


def as_of(df: DataFrame, v: Versions, read_ts: int | None = None, lower: Any = UNBOUNDED, upper: Any = UNBOUNDED) -> DataFrame:
    """The table as it was at ``read_ts``, keys in the range only."""
    return live(newest(df.where(in_range(list(v.keys), lower, upper)), v, read_ts), v)


def scan(df: DataFrame, v: Versions, lower: Any = UNBOUNDED, upper: Any = UNBOUNDED, read_ts: int | None = None, ordered: bool = True) -> DataFrame:
    """An as-of range scan in key order (``ordered=False`` saves the sort)."""
    found = as_of(df, v, read_ts, lower, upper)
    return found.orderBy(*v.keys) if ordered else found


def point_get(df: DataFrame, v: Versions, key: Any, read_ts: int | None = None) -> DataFrame:
    """The live version of one key: no rows or one. The sort keeps one row per task."""
    found = visible(df.where(equals(list(v.keys), key)), v, read_ts)
    return live(found.orderBy(*v.newest_first).limit(1), v)


def history(df: DataFrame, v: Versions, key: Any) -> DataFrame:
    """All versions of one key, tombstones included."""
    return df.where(equals(list(v.keys), key))


def changes(df: DataFrame, v: Versions, after: int, until: int) -> DataFrame:
    """Per key the first and last version in (after, until] and their number."""
    return (
        df.where((F.col(v.ts) > after) & (F.col(v.ts) <= until))
        .groupBy(*v.keys)
        .agg(F.min(v.ts).alias("min_ts"), F.max(v.ts).alias("max_ts"), F.count(F.lit(1)).alias("n"))
    )


def merge(inputs: Iterable[DataFrame], keys: Sequence[str], ordered: bool = True, source: str = "source") -> DataFrame:
    """Merge of sorted runs: for equal keys the input that comes first wins; ``source`` is its number."""
    tagged = [df.withColumn(source, F.lit(i)) for i, df in enumerate(inputs)]
    if not tagged:
        raise ValueError("nothing to merge")
    found = first_per_key(reduce(DataFrame.unionByName, tagged), keys, [F.col(source)])
    return found.orderBy(*keys) if ordered else found


def overlay(base: DataFrame, top: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``top`` and those rows of ``base`` whose key it lacks."""
    return top.unionByName(base.join(top.select(*keys), list(keys), "left_anti"))


def apply_writes(snapshot: DataFrame, writes: DataFrame, v: Versions) -> DataFrame:
    """A snapshot with a transaction's writes on top (one per key); tombstones erase."""
    untouched = snapshot.join(writes.select(*v.keys), list(v.keys), "left_anti")
    return untouched.unionByName(live(writes, v).select(*snapshot.columns))


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Keys whose value differs between two snapshots, nulls and absence told apart: ``old_value, new_value, kind``."""
    a = old.select(*keys, F.col(value).alias("old_value"), F.lit(True).alias("_a"))
    b = new.select(*keys, F.col(value).alias("new_value"), F.lit(True).alias("_b"))
    both = a.join(b, list(keys), "full")
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").otherwise("changed")
    return both.withColumn("kind", kind).where((F.col("kind") != "changed") | ~F.col("old_value").eqNullSafe(F.col("new_value"))).drop("_a", "_b")


def gc_keep(df: DataFrame, v: Versions, low_water: int, bottom: bool = False) -> DataFrame:
    """Versions that a reader at or above ``low_water`` can see: all above it and the newest at or below it.

    At the bottom, where nothing older lies beneath, that newest one goes too if it is a tombstone.
    Versions above the mark are not shuffled; of those below every task ships one per key.
    """
    above = df.where(F.col(v.ts) > low_water)
    below = newest(df, v, low_water)
    return above.unionByName(live(below, v) if bottom else below)


def gc_obsolete(df: DataFrame, v: Versions, low_water: int) -> DataFrame:
    """Per key the number of versions that :func:`gc_keep` drops."""
    n_old = F.count(F.when(F.col(v.ts) <= low_water, 1))
    return df.groupBy(*v.keys).agg((F.greatest(n_old - 1, F.lit(0))).cast("long").alias("n_obsolete")).where(F.col("n_obsolete") > 0)


def as_of_lookup(probe: DataFrame, df: DataFrame, v: Versions, at: str, width: int | None) -> DataFrame:
    """For every probe row (key columns and a time ``at``) the live version of its key at that time.

    Probes and versions are sorted together, and every probe takes the last version before it: rows
    are never multiplied. With ``width``, keys are also split into time ranges of that width, each
    of which starts from the last version of the ranges before, so that one hot key is spread.
    """
    keys = list(v.keys)
    values = [c for c in df.columns if c not in keys]
    held = F.struct(*values)
    rows = df.select(*keys, F.col(v.ts).alias("_at"), held.alias("_version"), *(F.lit(None).cast(t).alias(f"_p{i}") for i, (_, t) in enumerate(probe.dtypes)), F.lit(0).alias("_kind"))
    asked = probe.select(*keys, F.col(at).cast("long").alias("_at"), F.lit(None).cast(rows.schema["_version"].dataType).alias("_version"), *(F.col(c).alias(f"_p{i}") for i, c in enumerate(probe.columns)), F.lit(1).alias("_kind"))
    both = rows.unionByName(asked)
    order = [F.col("_at"), F.col("_kind"), *(F.col(f"_version.{c}") for c in v.ties)]
    if width is None:
        last = F.last("_version", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        found = both.withColumn("_found", last)
    else:
        both = both.withColumn("_range", F.floor(F.col("_at") / width))
        ends = both.where(F.col("_kind") == 0).groupBy(*keys, "_range").agg(F.max_by("_version", F.struct("_at", *(F.col(f"_version.{c}") for c in v.ties))).alias("_end"))
        starts = both.select(*keys, "_range").distinct().join(ends, [*keys, "_range"], "left")
        before = F.last("_end", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
        starts = starts.select(*keys, "_range", before.alias("_start"))
        last = F.last("_version", ignorenulls=True).over(Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
        found = both.join(starts, [*keys, "_range"]).withColumn("_found", F.coalesce(last, F.col("_start")))
    found = found.where((F.col("_kind") == 1) & F.col("_found").isNotNull() & ~F.col(f"_found.{v.tombstone}"))
    return found.select(*(F.col(f"_p{i}").alias(c) for i, c in enumerate(probe.columns)), *(F.col(f"_found.{c}").alias(c) for c in values))


def first_last(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest and largest key (a struct, if it has several columns) and the number of rows."""
    key = F.col(keys[0]) if len(keys) == 1 else F.struct(*keys)
    return df.agg(F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.count(F.lit(1)).alias("n"))
