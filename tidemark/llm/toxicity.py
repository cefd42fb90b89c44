"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other. Each has a logistic model over the words and word
beginnings of a document and over the probabilities of the categories before it. In training those
earlier probabilities are out-of-fold predictions, so that a later model learns how far to trust
what it will see on new documents; in use they are the predictions of the models before.

Training takes a bounded sample of labelled documents (``train_rows``, those with the smallest hash
of their id) to the driver, as sets of features; of near copies one stays, so that a text given a
thousand times does not outweigh all others. Features are exact strings chosen by how much more
often they occur on one side, so an unseen word cannot collide with a telling one. The model is a
dictionary of at most ``max_features`` strings, and every document is scored where it is read:
nothing is shuffled.

Defined results for odd input: a null or empty text has no features and gets the intercept's
probability; null ids and repeated rows are scored like all others; labels of absent documents are
ignored, of an id with several texts the smallest text counts, null labels count as 0; without
labels of both kinds a category's model is a constant; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import map_arrow

#: In chain order: a category's name and its 0/1 label from the columns of ``labels``.
CATEGORIES: tuple[tuple[str, str], ...] = (("low_quality", "1 - quality"), ("toxic", "toxic"))
TRAIN_ROWS = 6_000
MAX_FEATURES = 4096
BEGINNINGS = (4, 5)
FOLDS = 4
#: Min-hashes that near copies among the training rows agree in.
SKETCH = 6
#: A feature is taken if its share on the two sides differs by so many standard errors.
LEAST_Z = 6.0
LEAST_ROWS = 3
STEPS = 120
RIDGE = 1e-3
#: Of a category's out-of-fold predictions at its threshold.
LEAST_PRECISION = 0.95

_WORD = re.compile(r"\w+")


def features(text: str | None) -> set[str]:
    """Words of the lower-cased text, and the beginnings of longer ones (marked by a star)."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass(frozen=True)
class Model:
    """One category's logistic model."""

    weights: dict[str, float]
    earlier: tuple[float, ...]
    intercept: float

    def probability(self, found: set[str], before: list[float]) -> float:
        score = self.intercept + sum(w * p for w, p in zip(self.earlier, before, strict=True))
        get = self.weights.get
        score += sum(get(f, 0.0) for f in found)
        return 1 / (1 + math.exp(-min(max(score, -30.0), 30.0)))


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    models: tuple[Model, ...]
    #: Of each category: where its out-of-fold predictions part best (by F1), and their accuracy there.
    thresholds: tuple[float, ...]
    accuracy: tuple[float, ...]

    def probabilities(self, found: set[str]) -> list[float]:
        before: list[float] = []
        for model in self.models:
            before.append(model.probability(found, before))
        return before


class _Rows:
    """Rows of features, as positions in a vocabulary of everything that occurs often enough."""

    def __init__(self, found: pa.ListArray):
        coded = found.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        count = np.bincount(code, minlength=len(coded.dictionary))
        often = np.flatnonzero(count >= LEAST_ROWS)
        self.names = coded.dictionary.take(pa.array(often)).to_pylist()
        place = np.full(len(count), -1, np.int32)
        place[often] = np.arange(len(often), dtype=np.int32)
        row = np.repeat(np.arange(len(found), dtype=np.int32), np.diff(found.offsets.to_numpy()))
        live = place[code] >= 0
        self.row, self.feature, self.n = row[live], place[code[live]], len(found)

    def telling(self, y: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The features that tell the sides apart, over the rows in use."""
        live = used[self.row]
        total = np.bincount(self.feature[live], minlength=len(self.names))
        positive = np.bincount(self.feature[live], weights=y[self.row[live]], minlength=len(self.names))
        n, n1 = used.sum(), y[used].sum()
        share = np.where(total > 0, total / max(n, 1), 0)
        a, b = positive / max(n1, 1), (total - positive) / max(n - n1, 1)
        z = np.abs(a - b) / np.sqrt(share * (1 - share) * (1 / max(n1, 1) + 1 / max(n - n1, 1)) + 1e-12)
        best = np.argsort(-z, kind="stable")[:MAX_FEATURES]
        return np.sort(best[(z[best] >= LEAST_Z) & (total[best] >= LEAST_ROWS)])


def _fit(rows: _Rows, y: np.ndarray, before: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by accelerated gradient steps: chosen features, their weights, weights of earlier probabilities, intercept."""
    rate = np.clip(y[used].mean() if used.any() else 0.0, 1e-3, 1 - 1e-3)
    start = float(np.log(rate / (1 - rate)))
    chosen = rows.telling(y, used)
    if not used.any() or y[used].min() == y[used].max():
        return chosen[:0], np.zeros(0), np.zeros(before.shape[1]), start
    place = np.full(len(rows.names), -1)
    place[chosen] = np.arange(len(chosen))
    live = used[rows.row] & (place[rows.feature] >= 0)
    r, f = rows.row[live], place[rows.feature[live]]
    k, n = len(chosen), used.sum()

    def ahead(w):
        return np.bincount(r, weights=w[f], minlength=rows.n) + before @ w[k:-1] + w[-1]

    def back(e):
        return np.concatenate([np.bincount(f, weights=e[r], minlength=k), before.T @ e, [e.sum()]])

    v = np.ones(k + before.shape[1] + 1)
    for _ in range(8):  # the largest curvature, by power iteration
        v = back(ahead(v) * used)
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / (0.25 * top / n + RIDGE)
    w = np.zeros(len(v))
    w[-1] = start
    old, t = w, 1.0
    for _ in range(STEPS):
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        look = w + (last - 1) / t * (w - old)
        error = (_sigmoid(ahead(look)) - y) * used
        old, w = w, look - step * (back(error) / n + RIDGE * np.append(look[:-1], 0.0))
    return chosen, w[:k], w[k:-1], float(w[-1])


def _sigmoid(score):
    return 1 / (1 + np.exp(-np.clip(score, -30, 30)))


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the best F1 among those of ``LEAST_PRECISION``, half-way between the scores beside it; 0.5 if there is none."""
    if not len(y) or y.min() == y.max():
        return 0.5
    order = np.argsort(-p, kind="stable")
    p, hits = p[order], np.cumsum(y[order] > 0)
    taken = np.arange(1, len(p) + 1)
    f1 = np.where(hits >= LEAST_PRECISION * taken, 2 * hits / (taken + hits[-1]), -1.0)
    f1[:-1][p[:-1] == p[1:]] = -1  # no cut between equal scores
    k = int(f1.argmax())
    if f1[k] <= 0:
        return 0.5
    below = p[k + 1] if k + 1 < len(p) else 0.0
    cut = (np.log(p[k] / (1 - p[k])) + np.log(below / (1 - below))) / 2 if 0 < below and p[k] < 1 else np.log(p[k])
    return float(_sigmoid(cut))


def train(rows: list[set[str]] | pa.ListArray, labels: np.ndarray, keys: np.ndarray, names: tuple[str, ...], folds: int = FOLDS) -> Chain:
    """The chain from rows of features, their labels (one column per category) and integer keys that deal out the folds."""
    held = _Rows(rows if isinstance(rows, pa.ListArray) else pa.array([sorted(r) for r in rows], pa.list_(pa.string())))
    fold = keys % folds
    before = np.zeros((len(rows), 0))
    models, thresholds, accuracy = [], [], []
    for c in range(len(names)):
        y = labels[:, c].astype(float)
        out = np.zeros(len(rows))
        for k in range(folds):
            chosen, weights, earlier, intercept = _fit(held, y, before, fold != k)
            dense = np.zeros(len(held.names))
            dense[chosen] = weights
            score = np.bincount(held.row, weights=dense[held.feature], minlength=held.n) + before @ earlier + intercept
            out[fold == k] = _sigmoid(score)[fold == k]
        chosen, weights, earlier, intercept = _fit(held, y, before, np.ones(len(rows), bool))
        models.append(Model({held.names[f]: float(w) for f, w in zip(chosen, weights, strict=True)}, tuple(earlier.tolist()), intercept))
        thresholds.append(best_threshold(out, y))
        accuracy.append(float(((out >= thresholds[-1]) == (y > 0)).mean()) if len(rows) else 0.0)
        before = np.column_stack([before, out])
    return Chain(names, tuple(models), tuple(thresholds), tuple(accuracy))


def _features(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            found = [sorted(features(t)) for t in rows.column("text").to_pylist()]
            labels = [c for c in rows.schema.names if c.startswith("label_")]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(found, pa.list_(pa.string())), pa.array([_copies(f) for f in found], pa.int64()), *(rows.column(c) for c in labels)],
                names=["doc_id", "found", "sketch", *labels],
            )


def _copies(row: list[str]) -> int:
    """A hash of ``SKETCH`` min-hashes: equal for equal sets, mostly for nearly equal ones, hardly ever for others."""
    codes = np.array([zlib.crc32(f.encode()) for f in row] or [0], dtype=np.uint64)
    least = [int((codes * np.uint64(2 * k + 1) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)).min()) for k in range(SKETCH)]
    return zlib.crc32(repr(least).encode()) << 31 | zlib.crc32(repr(least[::-1]).encode()) >> 1


def fit(docs: DataFrame, labels: DataFrame, categories=CATEGORIES, train_rows: int = TRAIN_ROWS) -> Chain:
    """Train on at most ``train_rows`` labelled documents."""
    names = tuple(name for name, _ in categories)
    wanted = [F.coalesce(F.expr(label).cast("int"), F.lit(0)).alias(f"label_{k}") for k, (_, label) in enumerate(categories)]
    given = labels.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), *wanted)
    given = given.groupBy("doc_id").agg(*(F.max(c).alias(c) for c in given.columns[1:]))
    picked = given.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # At most train_rows rows are broadcast; of an id with several texts one is taken.
    sample = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), *(F.first(c).alias(c) for c in picked.columns[1:]))
    labels_of = picked.columns[1:]
    schema = ", ".join(["doc_id long", "found array<string>", "sketch long", *(f"{c} int" for c in labels_of)])
    held = map_arrow(sample, _features, schema).orderBy("doc_id").toArrow()
    first = np.sort(np.unique(held.column("sketch").to_numpy(), return_index=True)[1])  # of near copies the smallest id
    kept = held.take(pa.array(first))
    del held
    marks = np.column_stack([kept.column(c).to_numpy() for c in labels_of])
    keys = np.array([zlib.crc32(str(x).encode()) for x in kept.column("doc_id").to_pylist()], dtype=np.int64)
    found = kept.column("found").combine_chunks()
    del kept
    return train(found if isinstance(found, pa.ListArray) else found.chunk(0), marks, keys, names)


def _score(batches, chain: Chain) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            found = [chain.probabilities(features(t)) for t in rows.column("text").to_pylist()]
            columns = [pa.array([p[c] for p in found], pa.float64()) for c in range(len(chain.names))]
            kept = [name for name in rows.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*(rows.column(name) for name in kept), *columns], names=[*kept, *(f"p_{name}" for name in chain.names)])


def score(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """``doc_id``, the probability ``p_<category>`` of every category, and ``is_toxic`` (by the last)."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = ", ".join(["doc_id long", *(f"p_{name} double" for name in chain.names)])
    found = map_arrow(plain, functools.partial(_score, chain=chain), schema)
    return found.withColumn("is_toxic", F.col(f"p_{chain.names[-1]}") >= (chain.thresholds[-1] if threshold is None else threshold))


def _clean(batches, chain: Chain, threshold: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            keep = [chain.probabilities(features(t))[-1] < threshold for t in rows.column("text").to_pylist()]
            yield rows.filter(pa.array(keep, pa.bool_()))


def clean(docs: DataFrame, chain: Chain, threshold: float | None = None) -> DataFrame:
    """The documents below the threshold, with the columns of ``docs``."""
    limit = chain.thresholds[-1] if threshold is None else threshold
    return map_arrow(docs, functools.partial(_clean, chain=chain, threshold=limit), docs.schema)
