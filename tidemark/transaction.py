"""Transactions: a fixed read timestamp, buffered writes, and one atomic commit.

``snapshot``: the last committer wins. ``serializable``: the first committer wins, that is, a commit
fails if another transaction has committed one of its written keys since it began. With
``validate_reads`` the keys and ranges that it has read are checked as well.
"""

from __future__ import annotations

from enum import Enum
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tidemark.functions.bounds import UNBOUNDED, Bound, as_bound, contains, in_range
from tidemark.operators import conflicts, versions
from tidemark.sources.manifest import State
from tidemark.sources.runs import prune
from tidemark.table import SEQ, TS, Conflict, Table

if TYPE_CHECKING:
    from collections.abc import Iterable


class Status(Enum):
    ACTIVE = "active"
    COMMITTED = "committed"
    ABORTED = "aborted"


class Transaction:
    def __init__(self, table: Table, isolation: str, read_ts: int | None, validate_reads: bool):
        if isolation not in {"snapshot", "serializable"}:
            raise ValueError("isolation is 'snapshot' or 'serializable'")
        self.table, self.isolation, self.validate_reads = table, isolation, validate_reads
        self.snapshot: State = table.state()
        self.read_ts = self.snapshot.ts if read_ts is None else read_ts
        table._register(self.read_ts)
        self.status = Status.ACTIVE
        self.commit_ts: int | None = None
        self.writes: dict[tuple, tuple | None] = {}
        self.read_keys: set[tuple] = set()
        self.read_ranges: list[tuple[Bound, Bound]] = []

    @property
    def active(self) -> bool:
        return self.status is Status.ACTIVE

    def put(self, *row: Any) -> bool:
        if not self.active:
            return False
        n = len(self.table.keys)
        if len(row) != n + len(self.table.values):
            raise ValueError(f"a row is {[*self.table.keys, *self.table.values]}")
        self.writes[self.table._key(row[:n])] = tuple(row[n:])
        return True

    def delete(self, *key: Any) -> bool:
        if not self.active:
            return False
        self.writes[self.table._key(key)] = None
        return True

    def get(self, *key: Any) -> Row | None:
        """The row as this transaction sees it: its own write first."""
        if not self.active:
            return None
        key = self.table._key(key)
        if key in self.writes:
            value = self.writes[key]
            return None if value is None else Row(*self.table.keys, *self.table.values)(*key, *value)
        self.read_keys.add(key)
        return self.table.get(*key, read_ts=self.read_ts, state=self.snapshot)

    def scan(self, lower: Any = UNBOUNDED, upper: Any = UNBOUNDED, ordered: bool = True) -> DataFrame:
        """A range as this transaction sees it."""
        if not self.active:
            raise RuntimeError(f"the transaction is {self.status.value}")
        low, high = as_bound(lower, True), as_bound(upper, False)
        self.read_ranges.append((low, high))
        t = self.table
        base = t.scan(low, high, self.read_ts, ordered=False, state=self.snapshot)
        mine = {k: v for k, v in self.writes.items() if contains(low, high, k)}
        if mine:
            base = versions.apply_writes(base, t._rows(mine), t.v)
        return base.orderBy(*t.keys) if ordered else base

    def _since(self, state: State, where: Column | None = None) -> DataFrame:
        """Versions that this transaction has not seen: newer than its timestamp, or committed (at whatever timestamp) after its snapshot."""
        newer = [r for r in prune(state.runs, UNBOUNDED, UNBOUNDED) if r.max_ts > self.read_ts or r.seq > self.snapshot.version]
        rows = self.table._frame(newer).where((F.col(TS) > self.read_ts) | (F.col(SEQ) > self.snapshot.version))
        return rows if where is None else rows.where(where)

    def _keys_frame(self, keys: Iterable[tuple]) -> DataFrame:
        return self.table.spark.createDataFrame(list(keys), self.table.key_schema)

    def _validate(self, state: State) -> None:
        if state.version == self.snapshot.version and state.ts <= self.read_ts:
            return
        t = self.table
        watched = set(self.writes) | (self.read_keys if self.validate_reads else set())
        if watched and not conflicts.touched(self._since(state), self._keys_frame(watched), t.keys).isEmpty():
            raise Conflict("a key was committed by another transaction")
        if self.validate_reads and self.read_ranges:
            ranges = reduce(Column.__or__, (in_range(t.keys, low, high) for low, high in self.read_ranges))
            if not self._since(state, ranges).isEmpty():
                raise Conflict("a range that was read has changed")

    def commit(self) -> bool:
        """Publish all writes at one timestamp; ``False`` if the transaction is over or loses a conflict."""
        if not self.active:
            return False
        try:
            if self.writes:
                check = self._validate if self.isolation == "serializable" else None
                self.commit_ts = self.table.commit(self.table._rows(self.writes), files=1, validate=check, unique=True).ts
        except Conflict:
            self._end(Status.ABORTED)
            return False
        self._end(Status.COMMITTED)
        return True

    def abort(self) -> None:
        if self.active:
            self.writes.clear()
            self._end(Status.ABORTED)

    def _end(self, status: Status) -> None:
        self.status = status
        self.table._release(self.read_ts)

    def __enter__(self) -> Transaction:
        return self

    def __exit__(self, kind, *exc) -> None:
        if kind is not None:
            self.abort()
        elif self.active and not self.commit():
            raise Conflict("the transaction lost a conflict")
