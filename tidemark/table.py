"""A versioned table: sorted Parquet runs, a commit log, and snapshots of both.

    t = Table.create(spark, path, "k long", "value string")
    t.put(1, "a"); t.delete(2); t.flush()
    t.get(1); t.scan(lower=0, upper=10, read_ts=3)

Single writes are buffered and become one run at :meth:`Table.flush`; large ones come as DataFrames
(:meth:`Table.write`). Every commit gets the next timestamp. Readers resolve one state of the commit
log, pick the runs that can matter, and build one DataFrame over their files.
"""

from __future__ import annotations

import json
import logging
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from contextlib import ExitStack, contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.bounds import UNBOUNDED, Bound, as_bound, passes_filters
from tidemark.operators import versions
from tidemark.operators.versions import Versions
from tidemark.plans import compaction
from tidemark.sources.manifest import Commit, Manifest, State, Store
from tidemark.sources.runs import Run, encode_key, prune

MAX_TS = 2**63 - 1
#: Seconds after which a writer that has not come to its end counts as dead.
DEAD_AFTER = 24 * 3600.0
ROWS_PER_RANGE = 1 << 20
TS, TOMBSTONE, SEQ, POS = "_ts", "_tombstone", "_seq", "_pos"

logger = logging.getLogger(__name__)

#: Read timestamps in use, by table path: they hold back garbage collection.
_readers: dict[str, Counter] = {}
_lock = threading.RLock()


@dataclass(frozen=True)
class Options:
    strategy: str = "leveled"
    strategy_options: dict = field(default_factory=dict)
    target_file_bytes: int = 256 << 20
    flush_rows: int = 10_000
    retain_versions: int = 0
    bloom_filter: bool = True
    #: Whether a commit is followed by the compactions that the strategy calls for.
    auto_compact: bool = False


class Conflict(Exception):
    """Another transaction committed first."""


KEY_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BinaryType)


def _schema(given: str | T.StructType) -> T.StructType:
    return given if isinstance(given, T.StructType) else T._parse_datatype_string(given)


class Table:
    def __init__(self, spark: SparkSession, store: Store, keys: T.StructType, values: T.StructType, options: Options):
        self.spark, self.store, self.options = spark, store, options
        self.path = store.path
        self.key_schema, self.value_schema = keys, values
        self.keys = [f.name for f in keys]
        self.values = [f.name for f in values]
        self.manifest = Manifest(store)
        self.planner = compaction.planner(options.strategy, **options.strategy_options)
        self.v = Versions(keys=tuple(self.keys), ts=TS, tombstone=TOMBSTONE, ties=(SEQ, POS))
        self._state: State | None = None
        self._buffer: dict[tuple, tuple | None] = {}
        self._cached: list[DataFrame] = []

    # -- opening and closing

    @classmethod
    def create(cls, spark: SparkSession, path: str, keys: str | T.StructType, values: str | T.StructType, options: Options | None = None) -> Table:
        store, k, v, options = Store(spark, path), _schema(keys), _schema(values), options or Options()
        taken = {f.name for f in (*k, *v)} & {TS, TOMBSTONE, SEQ, POS}
        if taken or len({f.name for f in (*k, *v)}) < len(k) + len(v) or not len(k):
            raise ValueError(f"column names clash or keys are missing: {sorted(taken)}")
        if not all(isinstance(f.dataType, KEY_TYPES) for f in k):
            raise ValueError("keys are integers, strings or binary")
        held = {"keys": k.jsonValue(), "values": v.jsonValue(), "strategy": options.strategy, "strategy_options": options.strategy_options,
                "target_file_bytes": options.target_file_bytes, "flush_rows": options.flush_rows, "retain_versions": options.retain_versions,
                "bloom_filter": options.bloom_filter, "auto_compact": options.auto_compact}
        if not store.put("_table.json", json.dumps(held)):
            raise FileExistsError(f"there is a table at {store.path}")
        return cls(spark, store, k, v, options)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Table:
        store = Store(spark, path)
        x = json.loads(store.read("_table.json"))
        k, v = T.StructType.fromJson(x.pop("keys")), T.StructType.fromJson(x.pop("values"))
        return cls(spark, store, k, v, Options(**x))

    def close(self) -> None:
        """Commit what is buffered and drop what is cached."""
        self.flush()
        for df in self._cached:
            df.unpersist()
        self._cached.clear()

    def __enter__(self) -> Table:
        return self

    def __exit__(self, *exc) -> None:
        self.close()

    # -- state

    def state(self, version: int | None = None) -> State:
        if version is not None:
            return self.manifest.latest(version=version)
        self._state = self.manifest.latest(self._state)
        return self._state

    @property
    def latest_ts(self) -> int:
        return self.state().ts

    @contextmanager
    def reading(self, read_ts: int | None = None) -> Iterator[int]:
        """Hold a read timestamp, so that garbage collection keeps what it sees."""
        ts = self.latest_ts if read_ts is None else read_ts
        self._register(ts)
        try:
            yield ts
        finally:
            self._release(ts)

    def _register(self, ts: int) -> None:
        with _lock:
            _readers.setdefault(self.path, Counter())[ts] += 1

    def _release(self, ts: int) -> None:
        with _lock:
            held = _readers.get(self.path, Counter())
            held[ts] -= 1
            if held[ts] <= 0:
                del held[ts]

    def low_water(self) -> int:
        """The oldest read timestamp in use, or the latest commit's."""
        with _lock:
            active = list(_readers.get(self.path, ()))
        return min(active, default=self.latest_ts)

    # -- reading

    def _frame(self, runs: Sequence[Run]) -> DataFrame:
        kinds = [*self.key_schema, T.StructField(TS, T.LongType()), T.StructField(TOMBSTONE, T.BooleanType()), T.StructField(SEQ, T.LongType()), T.StructField(POS, T.LongType()), *self.value_schema]
        schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in kinds])
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/{r.path}" for r in runs))

    def versions_df(self, lower: Any = UNBOUNDED, upper: Any = UNBOUNDED, read_ts: int | None = None, state: State | None = None) -> DataFrame:
        """All committed versions that can matter for a range and a timestamp."""
        state = state or self.state()
        if read_ts is not None and read_ts < state.watermark:
            raise ValueError(f"versions below {state.watermark} have been collected")
        return self._frame(prune(state.runs, as_bound(lower, True), as_bound(upper, False), read_ts))

    def _pending(self) -> DataFrame | None:
        if not self._buffer:
            return None
        ts = self.latest_ts + 1
        return self._rows(self._buffer).withColumn(TS, F.lit(ts).cast("long")).withColumn(SEQ, F.lit(MAX_TS))

    def scan(self, lower: Any = UNBOUNDED, upper: Any = UNBOUNDED, read_ts: int | None = None, ordered: bool = True, state: State | None = None) -> DataFrame:
        """Live rows of a key range, as of ``read_ts`` (none: now, buffered writes included), in key order."""
        rows = self.versions_df(lower, upper, read_ts, state)
        if read_ts is None and state is None and (pending := self._pending()) is not None:
            rows = rows.unionByName(pending)
        found = versions.scan(rows, self.v, lower, upper, read_ts, ordered)
        return found.select(*self.keys, *self.values)

    def get(self, *key: Any, read_ts: int | None = None, state: State | None = None) -> Row | None:
        """One live row, or nothing."""
        key = self._key(key)
        if read_ts is None and state is None and key in self._buffer:
            value = self._buffer[key]
            return None if value is None else Row(*self.keys, *self.values)(*key, *value)
        rows = self.versions_df(Bound(key), Bound(key), read_ts, state)
        found = versions.point_get(rows, self.v, key, read_ts).select(*self.keys, *self.values).collect()
        return found[0] if found else None

    def lookup(self, probe: DataFrame, at: str, width: int | None = None) -> DataFrame:
        """The row of every probe (key columns and a timestamp column) as of its timestamp.

        ``width`` splits a key's history for tasks of their own; without it the runs' statistics give one for
        about ``ROWS_PER_RANGE`` versions, were they all of one key.
        """
        if width is None:
            held = self.state().runs
            span = max((r.max_ts for r in held), default=0) - min((r.min_ts for r in held), default=0) + 1
            width = max(1, span // max(1, sum(r.rows for r in held) // ROWS_PER_RANGE))
        found = versions.as_of_lookup(probe, self.versions_df(), self.v, at, width)
        return found.select(*probe.columns, *self.values)

    def history(self, *key: Any) -> DataFrame:
        """All versions of one key, newest first."""
        rows = self.versions_df(Bound(self._key(key)), Bound(self._key(key)))
        return versions.history(rows, self.v, self._key(key)).orderBy(*self.v.newest_first).select(*self.keys, F.col(TS).alias("ts"), F.col(TOMBSTONE).alias("is_tombstone"), *self.values)

    def changes(self, after: int, until: int) -> DataFrame:
        return versions.changes(self.versions_df(), self.v, after, until)

    def diff(self, old_ts: int, new_ts: int, value: str) -> DataFrame:
        return versions.diff(self.scan(read_ts=old_ts, ordered=False), self.scan(read_ts=new_ts, ordered=False), self.keys, value)

    def first_last(self, read_ts: int | None = None) -> Row:
        """Smallest and largest live key (a struct, if the key has several columns) and the number of live rows."""
        return versions.first_last(self.scan(read_ts=read_ts, ordered=False), self.keys).collect()[0]

    def sync(self) -> None:
        """Make buffered writes durable; a published commit is."""
        self.flush()

    def cache(self, **scan) -> DataFrame:
        """A scan that stays in memory until :meth:`close`."""
        df = self.scan(**scan).persist()
        self._cached.append(df)
        return df

    # -- writing

    def _key(self, key: tuple) -> tuple:
        if len(key) == 1 and isinstance(key[0], (tuple, list)):
            key = tuple(key[0])
        if len(key) != len(self.keys):
            raise ValueError(f"{len(key)} values for the key {self.keys}")
        if any(k is None or (isinstance(k, (bytes, bytearray, str)) and not len(k)) for k in key):
            raise ValueError("a key is neither null nor empty")
        return tuple(bytes(k) if isinstance(k, bytearray) else k for k in key)

    def put(self, *row: Any) -> None:
        """Buffer a row: key columns, then values."""
        n = len(self.keys)
        if len(row) != n + len(self.values):
            raise ValueError(f"a row is {[*self.keys, *self.values]}")
        self._buffer[self._key(row[:n])] = tuple(row[n:])
        self._maybe_flush()

    def delete(self, *key: Any) -> None:
        self._buffer[self._key(key)] = None
        self._maybe_flush()

    def _maybe_flush(self) -> None:
        if len(self._buffer) >= self.options.flush_rows:
            self.flush()

    def _rows(self, writes: dict[tuple, tuple | None]) -> DataFrame:
        """Buffered writes (one per key) as versions without a timestamp."""
        schema = T.StructType([*self.key_schema, T.StructField(TOMBSTONE, T.BooleanType()), T.StructField(POS, T.LongType()), *(T.StructField(f.name, f.dataType, True) for f in self.value_schema)])
        blank = (None,) * len(self.values)
        return self.spark.createDataFrame([(*k, v is None, i, *(blank if v is None else v)) for i, (k, v) in enumerate(writes.items())], schema)

    def flush(self) -> State | None:
        """Commit the buffered writes as one run."""
        if not self._buffer:
            return None
        writes, self._buffer = self._buffer, {}
        return self.commit(self._rows(writes), files=1, unique=True)

    def write(
        self, rows: DataFrame, tombstone: Column | None = None, ts: Column | None = None, info: dict | None = None, unique: bool = False, order_by: Column | Sequence[Column] | None = None
    ) -> State:
        """Commit a DataFrame of keys and values at one new timestamp, or at given ones (``ts``).

        Rows with a true ``tombstone`` are deletes. Of equal keys (and timestamps) the row with the
        largest ``order_by`` wins, and of equal ones the same row whenever it is asked; ``unique``
        promises that there are none and saves the exchange that looks for them.
        """
        flag = F.lit(False) if tombstone is None else F.coalesce(tombstone, F.lit(False))
        blank = [F.when(~F.col(TOMBSTONE), F.col(c)).alias(c) if c in rows.columns else F.lit(None).cast(self.value_schema[c].dataType).alias(c) for c in self.values]
        order = [] if order_by is None else [order_by] if isinstance(order_by, Column) else list(order_by)
        given = rows.withColumns({TOMBSTONE: flag, POS: F.lit(0).cast("long"), **({TS: ts.cast("long")} if ts is not None else {}), **{f"_order_{k}": c for k, c in enumerate(order)}})
        named = [TOMBSTONE, POS, *([TS] if ts is not None else [])]
        ranks = [f"_order_{k}" for k in range(len(order))]
        plain = given.select(*(F.col(c).cast(self.key_schema[c].dataType).alias(c) for c in self.keys), *named, *ranks, *blank)
        if not unique:
            hashed = [f.name for f in self.value_schema if "map<" not in f.dataType.simpleString()]
            first = [F.desc(c) for c in ranks] + [F.desc(TOMBSTONE), F.xxhash64(F.lit(0), *hashed).desc()]
            plain = versions.first_per_key(plain, [*self.keys, TS] if ts is not None else self.keys, first)
        return self.commit(plain.drop(*ranks), info=info, unique=True)

    @contextmanager
    def _writing(self) -> Iterator[str]:
        """A new folder for runs, declared to :meth:`vacuum` of any driver until the block ends."""
        name = uuid.uuid4().hex
        self.store.put(f"_writing/{name}", json.dumps({"since": time.time()}))
        try:
            yield f"runs/{name}"
        finally:
            self.store.delete(f"_writing/{name}")

    def commit(self, rows: DataFrame, files: int | None = None, validate: Callable[[State], None] | None = None, info: dict | None = None, unique: bool = False) -> State:
        """Write rows as new runs and publish them at the next timestamp.

        ``validate`` sees the state that the commit would follow and may raise. Who loses the race for
        a version stamps what it has written anew and tries the next.
        """
        state = self.state()
        stamped = TS in rows.columns
        source = rows if unique else versions.first_per_key(rows, [*self.keys, TS] if stamped else self.keys, [F.desc(POS)])
        with ExitStack() as open_folders:
            lost: list[str] = []
            while True:
                if validate is not None:
                    validate(state)
                version, folder = state.version + 1, open_folders.enter_context(self._writing())
                level = compaction.Tiered.new_tier(state.runs) if isinstance(self.planner, compaction.Tiered) else 0
                ready = source if stamped else source.withColumn(TS, F.lit(state.ts + 1).cast("long"))
                added = self._write_runs(ready.withColumn(SEQ, F.lit(version).cast("long")), folder, level, version, files)
                ts = max([state.ts, *(r.max_ts for r in added)]) if stamped else state.ts + 1
                if min((r.min_ts for r in added), default=0) < 0:
                    raise ValueError("timestamps are not negative")
                after = self.manifest.publish(Commit(version, ts, "append", tuple(added), (), info or {}), state)
                if after is not None:
                    break
                logger.info("%s: version %d went to another writer", self.path, version)
                lost.append(folder)
                written = self.spark.read.schema(self._frame([]).schema).parquet(f"{self.path}/{folder}") if added else self._frame([])
                source = written.drop(SEQ) if stamped else written.drop(SEQ, TS)
                state = self.state()
            for old in lost:
                self.store.delete(old)
        self._state = after
        logger.info("%s: version %d, timestamp %d, %d new runs", self.path, version, ts, len(added))
        return self._follow_up(after)

    def _follow_up(self, after: State) -> State:
        """The compactions that a commit calls for; they are not part of it, so that they may lose to other writers."""
        try:
            while self.options.auto_compact and (merged := self._compact()) is not None:
                after = merged
        except Conflict:
            logger.info("%s: compaction left to other writers", self.path)
        return after

    def _write_runs(self, rows: DataFrame, folder: str, level: int, seq: int, files: int | None = None) -> list[Run]:
        """Sorted files below ``folder``, each of a key range of its own (a key with very many versions may fill several)."""
        order = [*(F.col(k) for k in self.keys), F.desc(TS)]
        dealt = rows.coalesce(1) if files == 1 else rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
        names = self._frame([]).columns
        to = dealt.sortWithinPartitions(*order).select(*names).write
        if self.options.bloom_filter:
            to = to.option(f"parquet.bloom.filter.enabled#{self.keys[0]}", "true")
        to.parquet(f"{self.path}/{folder}")
        held = self.spark.read.schema(self._frame([]).schema).parquet(f"{self.path}/{folder}")
        key = F.struct(*self.keys)
        found = held.groupBy(F.col("_metadata.file_name").alias("f"), F.col("_metadata.file_size").alias("b")).agg(
            F.min(key).alias("lo"), F.max(key).alias("hi"), F.min(TS).alias("t0"), F.max(TS).alias("t1"), F.count(F.lit(1)).alias("n"), F.max(TOMBSTONE).alias("d")
        )
        return [
            Run(f"{folder}/{x['f']}", f"{folder}/{x['f']}", level, seq, tuple(map(_plain, x["lo"])), tuple(map(_plain, x["hi"])), x["t0"], x["t1"], x["n"], x["b"], x["d"])
            for x in sorted(found.collect(), key=lambda x: x["f"])  # one row per file
        ]

    # -- transactions

    def begin(self, isolation: str = "snapshot", read_ts: int | None = None, validate_reads: bool = False):
        """A transaction on the state as of ``read_ts`` (none: now)."""
        from tidemark.transaction import Transaction

        return Transaction(self, isolation, read_ts, validate_reads)

    # -- maintenance

    @property
    def filters(self) -> tuple:
        return self.state().filters

    def add_filter(self, prefix: str | bytes) -> None:
        """Let compaction, by whichever driver, drop the keys (by their first column) that begin with ``prefix``."""
        while True:
            state = self.state()
            if prefix in state.filters:
                return
            after = self.manifest.publish(Commit(state.version + 1, state.ts, "filter", info={"filters": encode_key([prefix])}), state)
            if after is not None:
                self._state = after
                return

    def _collectable(self, state: State) -> int:
        """The timestamp below which versions may go."""
        with _lock:
            oldest = min(_readers.get(self.path, ()), default=state.ts)
        return max(0, min(oldest, state.ts - self.options.retain_versions))

    def compact(self, full: bool = False) -> State | None:
        """Run the planner's next task, or (``full``) merge everything; nothing to do: ``None``.

        The merge drops versions that no reader can see, and tombstones if nothing older lies outside it.
        """
        self.flush()
        return self._compact(full)

    def _compact(self, full: bool = False) -> State | None:
        for _ in range(10):
            state = self.state()
            if full:
                target = 1 if not isinstance(self.planner, compaction.Tiered) else min((r.level for r in state.runs), default=1)
                task = compaction.Task(state.runs, (), target) if state.runs else None
            else:
                task = self.planner.plan(state.runs)
            if task is None:
                return None
            if (after := self._merge(state, task)) is not None:
                return after
        raise Conflict("other commits kept changing the runs that compaction merges")

    def _merge(self, state: State, task: compaction.Task) -> State | None:
        low = self._collectable(state)
        bottom = compaction.is_bottom(state.runs, task, low)
        rows = self._frame(task.inputs)
        rows = versions.first_per_key(rows, [*self.keys, TS], [F.desc(SEQ), F.desc(POS)])
        with _lock:
            read = bool(_readers.get(self.path))
        if state.filters and not read:
            # Versions that are retained stay; off the bottom a tombstone keeps what lies below from coming back.
            out = ~passes_filters(self.keys[0], state.filters) & (F.col(TS) <= low)
            rows = rows.withColumns({TOMBSTONE: F.col(TOMBSTONE) | out, **{c: F.when(~out, F.col(c)) for c in self.values}})
        kept = versions.gc_keep(rows, self.v, low, bottom)
        with self._writing() as folder:
            return self._publish_merge(state, task, kept, folder, low, bottom)

    def _publish_merge(self, state: State, task: compaction.Task, kept: DataFrame, folder: str, low: int, bottom: bool) -> State | None:
        added = self._write_runs(kept, folder, task.target, state.version + 1, compaction.output_files(task, self.options.target_file_bytes))
        gone = tuple(r.id for r in task.inputs)
        while True:
            info = {"watermark": low, "bottom": bottom}
            after = self.manifest.publish(Commit(state.version + 1, state.ts, "compact", tuple(added), gone, info), state)
            if after is not None:
                self._state = after
                logger.info("%s: merged %d runs into %d at level %d, low water %d", self.path, len(gone), len(added), task.target, low)
                return after
            state = self.state()
            there = {r.id for r in state.runs}
            if not set(gone) <= there or bottom != compaction.is_bottom(state.runs, task, low):
                self.store.delete(folder)
                return None

    def obsolete(self) -> DataFrame:
        """Per key, how many versions no reader can see."""
        return versions.gc_obsolete(self.versions_df(), self.v, self._collectable(self.state()))

    def garbage_collect(self) -> int:
        """Drop the versions that no reader can see; their number."""
        self.flush()
        before = sum(r.rows for r in self.state().runs)
        after = self.compact(full=True)
        return 0 if after is None else before - sum(r.rows for r in after.runs)

    def vacuum(self, older_than: float = 0.0, dead_after: float = DEAD_AFTER) -> int:
        """Delete the files that no state needs from now on, and the commits before the newest checkpoint; the number of files.

        Files of writers at work, in any driver, stay (those of writers that began more than ``dead_after`` seconds ago and
        have not ended go), and so do files younger than ``older_than`` seconds, which scans of other drivers may be reading.
        Refused while transactions are open here.
        """
        with _lock:
            if _readers.get(self.path):
                raise RuntimeError("transactions are open")
            now = time.time()
            # In this order: a file that is listed belongs to a declared writer, or is in the state that is read last, or is garbage.
            found = [(d, f, t) for d in self.store.names("runs") for f, t in self.store.modified(f"runs/{d}").items() if f.endswith(".parquet")]
            busy = {name for name, t in self.store.modified("_writing").items() if now - t < dead_after}
            needed = {r.path for r in self.state().runs}
            gone = [f"runs/{d}/{f}" for d, f, t in found if d not in busy and now - t >= older_than and f"runs/{d}/{f}" not in needed]
            for f in gone:
                self.store.delete(f)
            self.manifest.trim()
        return len(gone)


def _plain(value: Any) -> Any:
    return bytes(value) if isinstance(value, (bytes, bytearray)) else value
