"""Range ends and key predicates as columns, so that they reach the Parquet scan."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Bound:
    """One end of a range: a key that is included or excluded, or no limit."""

    key: Any = None
    closed: bool = True

    @property
    def unbounded(self) -> bool:
        return self.key is None


UNBOUNDED = Bound()


def included(key: Any) -> Bound:
    return Bound(key, True)


def excluded(key: Any) -> Bound:
    return Bound(key, False)


def as_bound(end: Any, closed: bool) -> Bound:
    """A plain value as an end of a half-open range."""
    return end if isinstance(end, Bound) else Bound(end, closed)


def _values(key: Any) -> tuple:
    return tuple(key) if isinstance(key, (tuple, list)) else (key,)


def key_literal(value: Any) -> Column:
    return F.lit(bytes(value)) if isinstance(value, (bytes, bytearray)) else F.lit(value)


def _compare(keys: list[str], values: tuple, strict_op: str, closed: bool) -> Column:
    """Lexicographic comparison of key columns with a (possibly shorter) tuple.

    A shorter tuple stands for all keys that begin with it. The first column is also compared by
    itself: that part can be pushed into a scan.
    """
    if len(values) > len(keys):
        raise ValueError(f"{len(values)} values for {len(keys)} key columns")
    less = strict_op == "<"
    found = F.lit(closed)
    for name, value in reversed(list(zip(keys, values, strict=False))):
        column, literal = F.col(name), key_literal(value)
        beyond = column < literal if less else column > literal
        found = beyond | ((column == literal) & found)
    if len(values) == 1:
        column, literal = F.col(keys[0]), key_literal(values[0])
        if less:
            return column <= literal if closed else column < literal
        return column >= literal if closed else column > literal
    first, literal = F.col(keys[0]), key_literal(values[0])
    return (first <= literal if less else first >= literal) & found


def lower_pred(keys: list[str], bound: Bound) -> Column:
    return F.lit(True) if bound.unbounded else _compare(keys, _values(bound.key), ">", bound.closed)


def upper_pred(keys: list[str], bound: Bound) -> Column:
    return F.lit(True) if bound.unbounded else _compare(keys, _values(bound.key), "<", bound.closed)


def in_range(keys: list[str], lower: Any = UNBOUNDED, upper: Any = UNBOUNDED) -> Column:
    """Keys from ``lower`` (plain value: included) to ``upper`` (plain value: excluded)."""
    low, high = as_bound(lower, True), as_bound(upper, False)
    parts = [p(keys, b) for p, b in ((lower_pred, low), (upper_pred, high)) if not b.unbounded]
    return reduce(Column.__and__, parts, F.lit(True)) if parts else F.lit(True)


def equals(keys: list[str], key: Any) -> Column:
    values = _values(key)
    if len(values) != len(keys):
        raise ValueError(f"{len(values)} values for {len(keys)} key columns")
    return reduce(Column.__and__, (F.col(k) == key_literal(v) for k, v in zip(keys, values, strict=True)))


def contains(bound_low: Bound, bound_high: Bound, key: Any) -> bool:
    """The same test on one key, on the driver."""
    k = _values(key)

    def inside(bound: Bound, less: bool) -> bool:
        if bound.unbounded:
            return True
        b = _values(bound.key)
        head = k[: len(b)]
        return bound.closed if head == b else (head < b) == less

    return inside(bound_low, False) and inside(bound_high, True)


def passes_filters(column: str, prefixes: Iterable[Any]) -> Column:
    """Whether a key begins with none of the prefixes."""
    return reduce(Column.__and__, (~F.startswith(F.col(column), key_literal(p)) for p in prefixes), F.lit(True))
