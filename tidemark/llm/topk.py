"""Exact top-k inner-product search with a pivot-distance index.

Vectors are rounded to integers and keyed by their nearest pivot and the distance to it; the index
is a table sorted by that key. A run of neighbouring rows of one pivot is an annulus: by the
triangle inequality no vector in it is nearer to a query than the gap between the query's distance
to a pivot and the annulus's, which bounds the inner product through the norms. The gap is taken over
all pivots: an annulus knows its nearest and farthest vector from each. Annuli are opened best bound
first and only for the queries whose k-th best score their bound still reaches.

The pivots come from a bounded sample, which also gives every query a first lower bound; all vectors
are indexed. Queries go in blocks of bounded size: neighbours in the index are asked together. For a
block the first bounds say, for every pivot, from which to which distance an annulus can matter at
all, and only that part of the index is read (the ranges are pushed into the scan, whose row groups
are sorted). The block is sent to the executors, every task returns its best k for each query, and a
grouped limit merges them. Copies of one vector, however many, are split over partitions by id.

How much stays closed depends on the vectors; :func:`opened` counts it. Of clustered vectors most
does; of independent ones in many dimensions, whose distances are all alike, nothing does, and the
search is then a blocked product of all queries with all vectors.

Defined results for odd input: vectors that are null, hold a null or a non-finite component, or one
whose integer does not fit a long take no part, and rows without id neither; of vectors of different
lengths the shorter one counts as if it ended in zeros; rows that repeat a query's id are candidates
for it and, if asked, queries of their own; equal scores go to the smaller id; with fewer than k
candidates all are returned; products are exact, and those beyond a long are its largest or smallest
value; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import map_arrow, materialize
from tidemark.sources.scratch import shared_path, temporary

K = 5
SCALE = 256
EVERY = 50
SAMPLE_ROWS = 4096
PIVOTS = 64
#: Queries sent to the executors at once.
QUERY_BLOCK = 8192
ANNULUS = 256
ROWS_PER_PARTITION = 1 << 13

INDEXED = "pivot int, distance double, at long, vec_id long, asked boolean, vec binary"
#: A row without a query counts pairs: opened ones in ``at``, all in ``score``.
FOUND = "query long, query_id long, at long, vec_id long, score long"


def integers(embeddings: DataFrame, is_query: Column, scale: int = SCALE) -> DataFrame:
    """``at`` (a number for each row), ``vec_id, asked, vec`` (array of long, all of one length) of the vectors that take part."""
    x = F.col("embedding").cast("array<double>")
    good = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) * scale < F.lit(2.0**63)))
    rows = embeddings.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(good)
    vec = F.transform(x, lambda c: F.floor(c * scale).cast("long"))
    rows = rows.select(F.monotonically_increasing_id().alias("at"), F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("asked"), vec.alias("vec"))
    held = materialize(rows, "vectors")
    sizes = held.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).collect()[0]
    if sizes["a"] == sizes["b"] and sizes["a"]:
        return held
    longest = F.lit(max(1, sizes["b"] or 0))
    return held.withColumn("vec", F.concat("vec", F.array_repeat(F.lit(0).cast("long"), longest - F.size("vec"))))


def _matrix(column: pa.Array | pa.ChunkedArray, rows: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy().reshape(rows, -1) if rows else np.zeros((0, 1), np.int64)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows: by floating point where every sum fits its 53 bits, by unbounded integers where one may not fit 63."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(np.float64)).max()) * float(np.abs(b.astype(np.float64)).max()) * a.shape[1]
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2**62:
        return a @ b.T
    exact = a.astype(object) @ b.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, pivots = x.astype(np.float64), pivots.astype(np.float64)
    square = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def choose_pivots(sample: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Vectors of the sample that lie far apart, each farthest from those before."""
    if not len(sample):
        return sample
    chosen = [0]
    gap = _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)) and gap.max() > 0:
        chosen.append(int(gap.argmax()))
        gap = np.minimum(gap, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _key(batches, pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x = _matrix(batch.column("vec"), batch.num_rows)
        d = _distances(x, pivots)
        near = d.argmin(1)
        yield pa.RecordBatch.from_arrays(
            [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(x)), near]), *(batch.column(c) for c in ("at", "vec_id", "asked")), pa.array([r.tobytes() for r in x.astype("<i8")], pa.binary())],
            names=["pivot", "distance", "at", "vec_id", "asked", "vec"],
        )


ORDER = ("pivot", "distance", "vec_id", "at")


def build(vectors: DataFrame, pivots: np.ndarray, rows: int) -> DataFrame:
    """The index: all vectors, sorted by nearest pivot, distance to it and id."""
    keyed = map_arrow(vectors, functools.partial(_key, pivots=pivots), INDEXED)
    return materialize(keyed.repartitionByRange(max(1, math.ceil(rows / ROWS_PER_PARTITION)), *ORDER).sortWithinPartitions(*ORDER), "pivot-index")


class _Best:
    """The k best of every query so far, equal scores by id."""

    def __init__(self, first: np.ndarray, k: int):
        self.k, self.floor = k, first.copy()
        self.query, self.score, self.id, self.at = (np.zeros(0, np.int64) for _ in range(4))

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, at: np.ndarray) -> None:
        q, s, i, a = (np.concatenate(x) for x in ((self.query, query), (self.score, score), (self.id, ids), (self.at, at)))
        order = np.lexsort((a, i, ~s, q))
        q, s, i, a = q[order], s[order], i[order], a[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.k
        self.query, self.score, self.id, self.at = q[keep], s[keep], i[keep], a[keep]
        last = rank == self.k - 1
        self.floor[q[last]] = np.maximum(self.floor[q[last]], s[last])


def _norms(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.float64) ** 2).sum(1)


class Queries:
    """A block of queries: their rows, vectors, distances to the pivots, and a score that each one's k-th best is known to reach."""

    def __init__(self, table: pa.Table, pivots: np.ndarray, sample: np.ndarray, sample_at: np.ndarray, k: int):
        self.at, self.id = table.column("at").to_numpy(), table.column("vec_id").to_numpy()
        self.x = np.frombuffer(b"".join(table.column("vec").to_pylist()), "<i8").reshape(len(self.at), -1)
        self.to_pivot, self.square = _distances(self.x, pivots), _norms(self.x)
        self.floor = np.full(len(self.at), np.iinfo(np.int64).min, np.int64)
        if len(sample) > k:
            for a in range(0, len(self.at), 1024):
                score = _products(self.x[a : a + 1024], sample)
                score[self.at[a : a + 1024, None] == sample_at[None]] = np.iinfo(np.int64).min
                self.floor[a : a + 1024] = np.partition(score, -k, axis=1)[:, -k]

    def reach(self, largest: dict[int, float]) -> dict[int, tuple[float, float]]:
        """For each pivot, between which distances to it a vector can reach a query's floor, given the largest squared norm there."""
        found = {}
        unknown = self.floor == np.iinfo(np.int64).min
        for p, norm in largest.items():
            # 2 q.x = |q|^2 + |x|^2 - |q - x|^2 is at least twice the floor only if |q - x| is at most this
            room = np.where(unknown, np.inf, self.square + norm - 2 * self.floor.astype(np.float64))
            able = (room >= -1e-6 * (self.square + norm)) & (unknown | (np.sqrt(self.square * norm) * (1 + 1e-9) + 1 >= self.floor))
            if able.any():
                far = np.sqrt(np.maximum(room[able], 0)) * (1 + 1e-6) + 1
                found[p] = (float((self.to_pivot[able, p] - far).min()), float((self.to_pivot[able, p] + far).max()))
        return found


def _search(batches, queries: Queries, pivots: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    best = _Best(queries.floor, k)
    opened = pairs = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        pivot, at, ids = (batch.column(c).to_numpy() for c in ("pivot", "at", "vec_id"))
        x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i8").reshape(batch.num_rows, -1)
        norm, distance = _norms(x), _distances(x, pivots)
        edges = np.flatnonzero(np.diff(pivot)) + 1
        cuts = sorted({*edges.tolist(), *range(0, len(x), ANNULUS), len(x)})
        rings = list(zip(cuts, cuts[1:], strict=False))
        pairs += len(queries.at) * len(x)
        bounds = np.empty((len(rings), len(queries.at)))
        for r, (a, b) in enumerate(rings):
            near, far = distance[a:b].min(0), distance[a:b].max(0)
            gap = np.maximum(np.maximum(near - queries.to_pivot, queries.to_pivot - far), 0).max(1)
            bounds[r] = np.minimum((queries.square + norm[a:b].max() - gap * gap) / 2, np.sqrt(queries.square * norm[a:b].max()))
        bounds = np.maximum(bounds + 1 + 1e-9 * (np.abs(bounds) + queries.square), -(2.0**63))  # rounding; no score is below a long
        for r in np.argsort(-(bounds - queries.floor).mean(1), kind="stable").tolist():
            a, b = rings[r]
            open_for = np.flatnonzero(bounds[r] >= best.floor)
            if not len(open_for):
                continue
            opened += len(open_for) * (b - a)
            score = _products(queries.x[open_for], x[a:b])
            hit = (score >= best.floor[open_for][:, None]) & (at[a:b][None] != queries.at[open_for][:, None])
            q, c = np.nonzero(hit)
            best.add(open_for[q], score[q, c], ids[a:b][c], at[a:b][c])
    columns = [queries.at[best.query], queries.id[best.query], best.at, best.id, best.score]
    counted = [None, None, opened, None, pairs]
    yield pa.RecordBatch.from_arrays([pa.array([*c.tolist(), n], pa.int64()) for c, n in zip(columns, counted, strict=True)], names=[c.split()[0] for c in FOUND.split(", ")])


def _within(reach: dict[int, tuple[float, float]]) -> Column:
    parts = [(F.col("pivot") == p) & F.col("distance").between(low, high) for p, (low, high) in reach.items()]
    return functools.reduce(Column.__or__, parts, F.lit(False))


def candidates(embeddings: DataFrame, is_query: Column, k: int = K, scale: int = SCALE, query_block: int = QUERY_BLOCK, sample_rows: int = SAMPLE_ROWS, pivots: int = PIVOTS) -> DataFrame:
    """``FOUND``: for every query row the ``k`` best of each task that had something to compare, and the tasks' counts."""
    with temporary(embeddings.sparkSession) as keep:
        found, path = _candidates(embeddings, is_query, k, scale, query_block, sample_rows, pivots)
        keep(path)
    return found


def _candidates(embeddings, is_query, k, scale, query_block, sample_rows, pivots) -> tuple[DataFrame, str]:
    spark = embeddings.sparkSession
    vectors = integers(embeddings, is_query, scale)
    picked = vectors.orderBy(F.xxhash64("vec_id"), "vec_id", "vec", "at").limit(sample_rows).toArrow()
    sample_at = picked.column("at").to_numpy()
    sample = _matrix(picked.column("vec"), len(sample_at))
    out = shared_path(spark, "best")
    center = choose_pivots(sample, pivots)
    if not len(sample):
        return spark.createDataFrame([], FOUND), out
    index = build(vectors, center, vectors.count())
    largest = {r["pivot"]: r["n"] for r in vectors_norms(index).groupBy("pivot").agg(F.max("n").alias("n")).collect()}  # one row per pivot
    asked = index.where("asked").select(*ORDER, "vec")
    blocks = max(1, math.ceil(asked.count() / query_block))
    asked = materialize(asked.repartitionByRange(blocks, *ORDER).withColumn("block", F.spark_partition_id()), "queries")
    spark.createDataFrame([], FOUND).write.parquet(out)
    for b in range(blocks):
        block = Queries(asked.where(F.col("block") == b).toArrow(), center, sample, sample_at, k)
        if not len(block.at):
            continue
        work = functools.partial(_search, queries=block, pivots=center, k=k)
        map_arrow(index.where(_within(block.reach(largest))), work, FOUND).write.mode("append").parquet(out)
    return spark.read.schema(FOUND).parquet(out), out


def vectors_norms(index: DataFrame) -> DataFrame:
    """``pivot, n``: every vector's pivot and squared norm."""

    def norms(batches):
        for batch in batches:
            if batch.num_rows:
                x = np.frombuffer(b"".join(batch.column("vec").to_pylist()), "<i8").reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([batch.column("pivot"), pa.array(_norms(x))], names=["pivot", "n"])

    return map_arrow(index.select("pivot", "vec"), norms, "pivot int, n double")


def opened(found: DataFrame, queries: int, vectors: int) -> float:
    """Share of all pairs of a query and a vector whose annulus was opened."""
    n = found.where(F.col("query").isNull()).agg(F.sum("at")).collect()[0][0] or 0
    return n / max(1, queries * vectors)


def best(found: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of every query row."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "at")
    ranked = found.where(F.col("query").isNotNull()).withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, is_query: Column, k: int = K, **options) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` best of every query row, exactly."""
    return best(candidates(embeddings, is_query, k, **options), k)


def report(embeddings: DataFrame) -> DataFrame:
    return search(embeddings, F.pmod(F.col("vec_id"), F.lit(EVERY)) == 0)
