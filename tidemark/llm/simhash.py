"""SimHash near-duplicates by a binary trie self-join.

Fingerprints are 64 majority bits over the hashes of a text's word shingles. They are the paths of
binary tries. A trie's root is a value that linked texts share, so that only what lies below one
root is compared:

* :func:`report` links fingerprints that differ in at most ``budget`` bits. Its roots are blocks of
  the fingerprint itself: of ``m`` blocks ``m - budget`` are equal in every such pair, so every
  choice of that many blocks is one trie and no link is lost. ``m`` grows with the number of
  fingerprints, for roots of a few dozen: 3 copies of each fingerprint up to a hundred million, 6 beyond.
* :func:`deduplicate` links texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or
  more. Fingerprints of such texts differ in 10 bits on average, too many for blocks, so the roots
  are the texts' smallest shingles under ``ROOTS`` hash functions (a pair at 0.8 shares none once in
  400 000), the error budget is 18 bits (a pair at 0.8 exceeds it twice in 1000), and every pair that
  is left is checked on the whole sets of shingles. Pairs below 0.8 are never linked. What roots, budget
  and parted roots may have lost is found exactly (:func:`missed_links`): two texts at 0.8 share one of
  the first shingles of each in any one order, as many as a fifth of them and one more. Texts of different
  components that meet below such a shingle, and pass bounds that no linked pair can fail, get into one
  cluster, and the texts of a cluster are compared with each other.

The join walks pairs of trie nodes from the root down. A pair adds up the bits in which its nodes'
paths differ and is dropped as soon as they exceed the budget; pairs too small to be pruned are
compared outright. Roots that stay crowded are dealt into blocks by hash and joined block against block, so no
task holds more than two blocks. Equal fingerprints (or texts) are one entry, so a group of
copies of any size costs one. A task returns a spanning forest of the links that it found, not the
links, and compares what its forest does not join already. Components come from those forests
(:mod:`tidemark.llm.components`).

Defined results for odd input: texts without words, null ones too, have fingerprint zero and are
linked like any other; texts with fewer words than a shingle have one shingle, all their words;
repeated rows are members of one component; a null ``doc_id`` never names a component unless all its
members' ids are null; an empty table gives an empty result; further input columns, whatever their
names, are ignored by the fingerprints and kept by :func:`deduplicate`.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import map_arrow, materialize, ship, store
from tidemark.llm.components import components
from tidemark.sources.scratch import remove, temporary

BITS = 64
#: Of the links between fingerprints.
WORDS = 3
SEED = 42
BUDGET = 2
#: Of the links between texts.
NEAR_WORDS = 5
SIMILARITY = 0.8
NEAR_BUDGET = 18
ROOTS = 8
#: Fingerprints that a root should hold on average.
ROOT_SIZE = 64
#: Entries of one block of a crowded root.
UNIT = 1 << 11
#: Blocks of a root beyond which it is parted by further shingles, and how many shingles there can be.
BLOCKS = 32
LEVELS = 3
#: Entries, and bytes of shingles, that a task gets at once on average.
TASK_ROWS = 1 << 13
TASK_BYTES = 1 << 22
#: Node pairs and compared pairs that a task holds at once.
CHUNK = 1 << 16
PAIRS = 1 << 20
LEAF = 64
#: Texts, and characters of each, that tell which shingles are frequent; their order is all that depends on it.
COMMON_ROWS = 1 << 10
COMMON_CHARS = 1 << 14
COMMON = 1 << 16
#: Bins that a set's shingles are counted in by their highest bits, at least (by its size) and at most; pairs whose bins are compared at once.
BINS = 64
FINE_BINS = 1 << 10
BIN_PAIRS = 1 << 12


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    set_in = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), CHUNK):
        set_in += np.unpackbits(hashes[k : k + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_in > len(hashes), bitorder="little").view("<u8")[0])


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8").lower().split()  # of bytes: A-Z only, and the six ASCII spaces


def fingerprint(text: str | None) -> int:
    """Of the 3-word shingles, repeats included."""
    words = _words(text)
    if not words:
        return 0
    if len(words) <= WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - WORDS + 1].tolist()
    stops = (ends[WORDS - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)], dtype="<u8"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, words: int = NEAR_WORDS) -> np.ndarray:
    """Hashes of the different shingles, sorted."""
    held = np.array([xxhash.xxh3_64_intdigest(w) for w in _words(text)], dtype=np.uint64)
    if not len(held):
        return held
    n = max(1, len(held) - words + 1)
    found = np.zeros(n, np.uint64)
    for k in range(min(words, len(held))):
        found = _mix(found * np.uint64(0x9E3779B97F4A7C15) + held[k : k + n])
    return np.unique(found)


def roots_of(held: np.ndarray, count: int = ROOTS) -> list[int]:
    """The smallest shingle under each of ``count`` hash functions."""
    if not len(held):
        return [0] * count
    return [int(_mix(_mix(held ^ np.uint64(k + 1)) * np.uint64(2 * k + 3)).min()) for k in range(count)]


def _fingerprints(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            found = np.array([fingerprint(t) for t in rows.column("text").to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("tie"), pa.array(found)], names=["doc_id", "tie", "fingerprint"])


def first_shingles(held: np.ndarray, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The first shingles in an order that all texts share, rare ones first: sets of this similarity have one of them in common."""
    values, counts = common
    count = max(0, len(held) - math.ceil(similarity * len(held) - 1e-9) + 1) if len(held) else 0
    if len(values):
        at = np.minimum(np.searchsorted(values, held), len(values) - 1)
        frequent = np.where(values[at] == held, counts[at], 0)
    else:
        frequent = np.zeros(len(held), np.int64)
    return held[np.lexsort((_mix(held), frequent))[:count]]


def bins(held: np.ndarray, count: int = BINS) -> bytes:
    """How many shingles there are in each bin, up to 255; ``count``: a power of two."""
    return np.minimum(np.bincount((held >> np.uint64(BITS + 1 - count.bit_length())).astype(np.int64), minlength=count), 255).astype(np.uint8).tobytes()


def bins_by_size(held: np.ndarray) -> bytes:
    """Bins for two to four shingles each."""
    return bins(held, min(FINE_BINS, max(BINS, 1 << (len(held) // 4).bit_length())))


def most_apart(n, similarity: float):
    """In how many shingles two sets of together ``n`` at most differ, and so the counts in any bins."""
    return n * (1 - similarity) / (1 + similarity) + 1e-6


def common_shingles(docs: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a bounded sample of the texts has more than once, sorted, and how often."""
    picked = _plain(docs).select(F.substring("text", 1, COMMON_CHARS).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).limit(COMMON_ROWS)
    held = [shingles(t, words) for t in {r.text for r in picked.collect()}]
    values, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *held]), return_counts=True)
    most = np.sort(np.argsort(-counts, kind="stable")[:COMMON])
    most = most[counts[most] > 1]
    return values[most], counts[most]


def _signatures(batches, words: int, count: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            texts = rows.column("text").to_pylist()
            held = [shingles(t, words) for t in texts]
            node = np.array([xxhash.xxh3_64_intdigest(b" ".join(_words(t))) for t in texts], np.uint64)
            prints = np.array([majority(h) if len(h) else 0 for h in held], np.uint64)
            roots = np.array([roots_of(h, count) for h in held], np.uint64).reshape(-1)
            first = [first_shingles(h, similarity, common) for h in held]
            ends = np.cumsum([0, *(len(x) for x in first)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("tie"), pa.array(node.view(np.int64)), pa.array(prints.view(np.int64)), pa.array([len(h) for h in held], pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(held) + 1, dtype=np.int32) * count), pa.array(roots.view(np.int64))),
                 pa.array([bins_by_size(h) for h in held], pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *first]).view(np.int64)))],
                names=["doc_id", "tie", "node", "fp", "n", "roots", "bins", "first"],
            )


def _sets(batches, words: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            rows = batch.slice(k, 256)
            held = [shingles(t, words).tobytes() for t in rows.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([rows.column("node"), pa.array(held, pa.binary())], names=["node", "held"])


def tie() -> Column:
    """Tells apart rows of one id with different texts."""
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), tie().alias("tie"), F.col("text").cast("string").alias("text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    return map_arrow(_plain(docs), _fingerprints, "doc_id long, tie long, fingerprint long")


def block_masks(count: int, budget: int) -> list[int]:
    """Bits of every trie's root among ``count`` fingerprints: pairs within the budget agree in all bits of one mask."""
    blocks = budget + 1
    while blocks < BITS and count / 2.0 ** (BITS * (blocks - budget) // blocks) > ROOT_SIZE:
        blocks += 1
    cuts = [BITS * k // blocks for k in range(blocks + 1)]
    whole = [((1 << cuts[k + 1]) - 1) ^ ((1 << cuts[k]) - 1) for k in range(blocks)]
    return [sum(chosen) for chosen in itertools.combinations(whole, blocks - budget)]


class _Forest:
    """Union by smallest index."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return up
            self.parent = up

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            root = self.roots()
            a, b = root[i], root[j]
            apart = a != b
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.parent, np.maximum(a, b), np.minimum(a, b))


def walk(fp: np.ndarray, alo, ahi, blo, bhi, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of fingerprints within the budget below pairs of tries.

    A trie is a sorted range of ``fp``: [alo, ahi) against [blo, bhi), or against itself where the two
    are the same.
    """
    ones: dict[int, np.ndarray] = {}
    # A pair of nodes is first pruned more than ``budget`` levels down, where it has become 4 ** budget pairs.
    leaf = LEAF << min(2 * budget, 30)
    stack = [(0, [np.asarray(x, np.int64) for x in (alo, ahi, blo, bhi)] + [np.zeros(len(alo), np.int64)])]
    while stack:
        depth, work = stack.pop()
        if len(work[0]) > CHUNK:
            half = len(work[0]) // 2
            stack += [(depth, [x[half:] for x in work]), (depth, [x[:half] for x in work])]
            continue
        alo, ahi, blo, bhi, errors = work
        small = ((ahi - alo) * (bhi - blo) <= leaf) | (depth >= BITS)
        yield from _outright(fp, *(x[small] for x in work[:4]), budget)
        alo, ahi, blo, bhi, errors = (x[~small] for x in work)
        if not len(alo):
            continue
        if depth not in ones:
            ones[depth] = np.concatenate([[0], np.cumsum(fp >> np.uint64(BITS - 1 - depth) & np.uint64(1), dtype=np.int64)])
        amid, bmid = (hi - (ones[depth][hi] - ones[depth][lo]) for lo, hi in ((alo, ahi), (blo, bhi)))
        twin = alo == blo
        parts = []
        for x0, x1, y0, y1, more, wanted in ((alo, amid, blo, bmid, 0, True), (amid, ahi, bmid, bhi, 0, True), (alo, amid, bmid, bhi, 1, True), (amid, ahi, blo, bmid, 1, ~twin)):
            live = (x1 > x0) & (y1 > y0) & (errors + more <= budget) & wanted
            parts.append([x[live] for x in (x0, x1, y0, y1, errors + more)])
        stack.append((depth + 1, [np.concatenate(x) for x in zip(*parts, strict=True)]))


def _outright(fp, alo, ahi, blo, bhi, budget):
    """Pairs below small nodes, compared on all bits, a bounded number at a time."""
    n = ahi - alo
    i = np.repeat(alo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    low = np.where(np.repeat(alo == blo, n), i + 1, np.repeat(blo, n))
    for left, right in _spans(i, low, np.repeat(bhi, n) - low):
        near = np.bitwise_count(fp[left] ^ fp[right]) <= budget
        yield left[near], right[near]


def _spans(i: np.ndarray, low: np.ndarray, width: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each index in ``i`` with ``width`` indices from ``low`` on, a bounded number at a time."""
    some = width > 0
    i, low, width = i[some], low[some], width[some]
    upto = np.cumsum(width)
    at = 0
    while at < len(i):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        w = width[at:to]
        left = np.repeat(i[at:to], w)
        right = np.repeat(low[at:to], w) + np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w)
        yield left, right
        at = to


class _Dealt:
    """The rows of one task: whole units, each a range of the arrays with its two sides sorted by fingerprint."""

    def __init__(self, batches):
        held = pa.Table.from_batches(batches)
        columns = {c: held.column(c).to_numpy() for c in ("key", "i", "j", "side", "elsewhere", "node", "fp")}
        fp = np.array(columns["fp"], np.int64).view(np.uint64)
        order = np.lexsort((fp, columns["side"], columns["j"], columns["i"], columns["key"]))
        self.table, self.order, self.fp = held, order, fp[order]
        self.node, self.elsewhere = columns["node"][order], columns["elsewhere"][order]
        unit = [columns[c][order] for c in ("key", "i", "j")]
        side = columns["side"][order]
        new = np.ones(len(order), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in unit])
        self.start = np.flatnonzero(new)
        self.stop = np.append(self.start[1:], len(order))
        self.middle = self.stop - np.add.reduceat(side.astype(np.int64), self.start) if len(order) else self.stop
        self.self_join = unit[1][self.start] == unit[2][self.start]
        self.prior = held.column("prior").combine_chunks().flatten().to_numpy().reshape(len(order), -1)[order]

    def pairs(self, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates, each in the first of the tries that its two entries share."""
        blo = np.where(self.self_join, self.start, self.middle)
        ahi = np.where(self.self_join, self.stop, self.middle)
        some = (ahi > self.start) & (self.stop > blo)
        for a, b in walk(self.fp, self.start[some], ahi[some], blo[some], self.stop[some], budget):
            if self.prior.shape[1] and len(a):
                elsewhere = (self.elsewhere[a][:, None] >> np.arange(self.prior.shape[1])[None] & 1).astype(bool)
                first = ~((self.prior[a] == self.prior[b]) & elsewhere).any(axis=1)
                a, b = a[first], b[first]
            yield a, b


def _edges(dealt: _Dealt, forest: _Forest) -> pa.RecordBatch:
    root = forest.roots()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(dealt.node[root[linked]]), pa.array(dealt.node[linked])], names=["a", "b"])


def _join(_key, batches, budget: int) -> Iterator[pa.RecordBatch]:
    """The spanning forest of the links in one task's units."""
    dealt = _Dealt(list(batches))
    forest = _Forest(len(dealt.fp))
    for i, j in dealt.pairs(budget):
        forest.link(i, j)
    yield _edges(dealt, forest)


def _candidates(_key, batches, budget: int) -> Iterator[pa.RecordBatch]:
    """The rows that have a candidate partner in their unit."""
    dealt = _Dealt(list(batches))
    live = np.zeros(len(dealt.fp), bool)
    for i, j in dealt.pairs(budget):
        live[i] = live[j] = True
    yield from dealt.table.take(pa.array(dealt.order[live])).combine_chunks().to_batches()


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have at least this Jaccard similarity."""
    if min(len(a), len(b)) < similarity * max(len(a), len(b)) - 1e-9:
        return False
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common >= similarity * (len(both) - common) - 1e-9


def _verify(_key, batches, budget: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """The spanning forest of the candidates whose sets are alike, the nearest pairs checked first."""
    dealt = _Dealt(list(batches))
    held = [np.frombuffer(x.as_buffer(), "<u8") for x in dealt.table.column("held").take(pa.array(dealt.order))]
    forest = _Forest(len(held))
    for i, j in dealt.pairs(budget):
        nearest = np.argsort(np.bitwise_count(dealt.fp[i] ^ dealt.fp[j]), kind="stable")
        i, j, size = i[nearest], j[nearest], 64
        while len(i):
            root = forest.roots()
            apart = root[i] != root[j]
            i, j = i[apart], j[apart]
            good = np.array([alike(held[x], held[y], similarity) for x, y in zip(i[:size].tolist(), j[:size].tolist(), strict=True)], bool)
            forest.link(i[:size][good], j[:size][good])
            i, j, size = i[size:], j[size:], min(2 * size, 4096)
    yield _edges(dealt, forest)


ROWS = "key long, i int, j int, side int, elsewhere long, node long, fp long, n long, prior array<long>"


def units(entries: DataFrame, roots: Column, unit: int = UNIT, blocks: int = BLOCKS, levels: int = 1) -> DataFrame:
    """``ROWS``: every entry (``node, fp, n, prior``) below each of its roots that has others.

    Roots of more than ``blocks`` blocks are parted by further ones of the entries' ``prior`` shingles, up to
    ``levels``; the others come as pairs of blocks. Bits of ``elsewhere`` stand for the shingles of ``prior``
    that send a pair which shares them to another trie.
    """
    rows = entries.select("node", "fp", "n", "prior", F.posexplode(roots).alias("k", "root"))
    rows = rows.select(F.xxhash64("k", "root").alias("key"), F.expr("shiftleft(1L, k)").alias("fixed"), F.expr("shiftleft(1L, k) - 1").alias("elsewhere"), "node", "fp", "n", "prior")
    done = []
    for level in range(1, levels + 1):
        shared = rows.groupBy("key").agg(F.count(F.lit(1)).alias("here")).where(F.col("here") > 1)
        live = materialize(rows.join(shared, "key").withColumn("blocks", F.ceil(F.col("here") / unit).cast("int")), "trie-rows")
        crowded = F.col("blocks") > blocks if level < levels else F.lit(False)
        done.append(live.where(~crowded))
        live = live.where(crowded)
        if level == levels or live.isEmpty():
            break
        deeper = live.select("key", "fixed", "elsewhere", "node", "fp", "n", "prior", F.posexplode("prior").alias("k", "root")).where(F.expr("fixed & shiftleft(1L, k)") == 0)
        earlier = F.expr("elsewhere | ((shiftleft(1L, k) - 1) & ~fixed)")
        rows = deeper.select(F.xxhash64("key", "k", "root").alias("key"), F.expr("fixed | shiftleft(1L, k)").alias("fixed"), earlier.alias("elsewhere"), "node", "fp", "n", "prior")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = functools.reduce(DataFrame.unionByName, done).withColumn("block", block)
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine, other = F.col("block"), F.col("other")
    return pairs.select("key", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), (mine > other).cast("int").alias("side"), "elsewhere", "node", "fp", "n", "prior")


def _grouped(rows: DataFrame, groups: int):
    ship(rows.sparkSession)
    return rows.withColumn("task", F.pmod(F.xxhash64("key", "i", "j"), F.lit(max(1, groups)))).groupBy("task")


def links(distinct: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """Forests ``a, b`` of all links between distinct fingerprints (``fp``)."""
    masks = block_masks(distinct.count(), budget)
    entries = distinct.select(F.col("fp").alias("node"), "fp", F.lit(0).cast("long").alias("n"), F.array().cast("array<long>").alias("prior"))
    signed = [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]
    rows = units(entries, F.array(*(F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed)), unit)
    return _grouped(rows, math.ceil(rows.count() / TASK_ROWS)).applyInArrow(_two(functools.partial(_join, budget=budget)), "a long, b long")


def _two(work):
    """``work`` with the two annotated arguments that Spark reads."""

    def group(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(key, batches)

    return group


def _sets_of(docs: DataFrame, entries: DataFrame, nodes: DataFrame, words: int, again: bool) -> DataFrame:
    """``node, held``: the whole sets of shingles of ``nodes``."""
    wanted = entries.select("node", F.col("best.doc_id").alias("best_id"), F.col("best.tie").alias("best_tie")).join(nodes.distinct(), "node", "left_semi")
    wanted = materialize(wanted, "wanted")  # if it is small, its size says so, and the texts need no shuffle
    found = _plain(docs).join(wanted, F.col("doc_id").eqNullSafe(F.col("best_id")) & (F.col("tie") == F.col("best_tie")))
    if again:
        found = found.dropDuplicates(["node"])
    return materialize(map_arrow(found.select("node", "text"), functools.partial(_sets, words=words), "node long, held binary"), "shingles")


def near_links(docs: DataFrame, entries: DataFrame, words: int, similarity: float, budget: int, unit: int = UNIT, blocks: int = BLOCKS, again: bool = True) -> DataFrame:
    """Forests ``a, b`` of the links between different texts that share a root and are within the budget: ``entries`` has ``node, fp, n, prior`` and the ``best`` document of each.

    ``again``: whether whole rows may be given more than once.
    """
    rows = units(entries, F.col("prior"), unit, blocks, LEVELS)
    candidates = _grouped(rows, math.ceil(rows.count() / TASK_ROWS)).applyInArrow(_two(functools.partial(_candidates, budget=budget)), f"{ROWS}, task long")
    candidates = materialize(candidates.drop("task"), "candidates")
    sets = _sets_of(docs, entries, candidates.select("node"), words, again)
    size = candidates.agg(F.count(F.lit(1)).alias("rows"), F.sum(8 * F.col("n")).alias("bytes")).collect()[0]
    groups = max(math.ceil(size["rows"] / TASK_ROWS), math.ceil((size["bytes"] or 0) / TASK_BYTES))
    work = functools.partial(_verify, budget=budget, similarity=similarity)
    return _grouped(candidates.join(sets, "node"), groups).applyInArrow(_two(work), "a long, b long")


class _Apart:
    """The rows of one task: whole units, each a range with its two sides sorted by component."""

    def __init__(self, batches):
        held = pa.Table.from_batches(batches)
        columns = {c: held.column(c).to_numpy() for c in ("key", "i", "j", "side", "root", "node", "n")}
        self.table, self.order = held, np.lexsort([columns[c] for c in ("root", "side", "j", "i", "key")])
        self.columns = {c: x[self.order] for c, x in columns.items()}
        self.n, self.root = self.columns["n"], self.columns["root"]
        counts = [np.frombuffer(x, np.uint8) for x in held.column("bins").take(pa.array(self.order)).to_pylist()]
        self.width = np.array([len(x) for x in counts], np.int64)
        self.counts = {int(w): self._folded(counts, int(w)) for w in np.unique(self.width)}
        self.nodes, self.node = np.unique(self.columns["node"], return_inverse=True)

    @staticmethod
    def _folded(counts: list[np.ndarray], width: int) -> np.ndarray:
        """The counts of all rows of so many bins or more, added up to so many."""
        found = np.zeros((len(counts), width), np.uint8)
        for k, x in enumerate(counts):
            if len(x) >= width:
                found[k] = x if len(x) == width else np.minimum(x.reshape(width, -1).sum(axis=1, dtype=np.int64), 255)
        return found

    def _runs(self, *names: str) -> tuple[np.ndarray, np.ndarray]:
        """Where the run of equal values that each row lies in starts and stops."""
        new = np.ones(len(self.order), bool)
        new[1:] = np.logical_or.reduce([self.columns[c][1:] != self.columns[c][:-1] for c in names])
        start, of = np.flatnonzero(new), np.cumsum(new) - 1
        return start[of], np.append(start[1:], len(new))[of]

    def _spans(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Within a block a row meets the components behind its own; across blocks it meets the other block but for its own component."""
        unit, side, same = (self._runs("key", "i", "j", *more) for more in ((), ("side",), ("side", "root")))
        within = self.columns["i"] == self.columns["j"]
        yield np.flatnonzero(within), same[1][within], (unit[1] - same[1])[within]
        left = np.flatnonzero(~within & (self.columns["side"] == 0))
        low, high = side[1][left], unit[1][left]
        skip, past = low.copy(), low.copy()
        for a in np.unique(low):
            mine = low == a
            there, own = self.root[a : high[mine][0]], self.root[left[mine]]
            skip[mine], past[mine] = a + np.searchsorted(there, own), a + np.searchsorted(there, own, "right")
        yield left, low, skip - low
        yield left, past, high - past

    def pairs(self, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of different components that sizes and bins do not rule out."""
        for a, b in itertools.chain.from_iterable(_spans(*s) for s in self._spans()):
            sized = np.minimum(self.n[a], self.n[b]) >= similarity * np.maximum(self.n[a], self.n[b]) - 1e-9
            a, b = a[sized], b[sized]
            width = np.minimum(self.width[a], self.width[b])
            for w in np.unique(width).tolist():
                x, y = a[width == w], b[width == w]
                near = within_bins(self.counts[w], self.n, x, y, similarity)
                yield x[near], y[near]


def within_bins(counts: np.ndarray, n: np.ndarray, a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether the sets of each pair can be so similar by the counts in their bins."""
    near = [np.zeros(0, bool)]
    for k in range(0, len(a), BIN_PAIRS):
        x, y = a[k : k + BIN_PAIRS], b[k : k + BIN_PAIRS]
        near.append(np.abs(counts[x].astype(np.int16) - counts[y]).sum(axis=1) <= most_apart(n[x] + n[y], similarity))
    return np.concatenate(near)


def _forest_of(apart: _Apart, forest: _Forest) -> pa.RecordBatch:
    root = forest.roots()
    linked = np.flatnonzero(root != np.arange(len(root)))
    return pa.RecordBatch.from_arrays([pa.array(apart.nodes[root[linked]]), pa.array(apart.nodes[linked])], names=["a", "b"])


def _clusters(_key, batches, similarity: float) -> Iterator[pa.RecordBatch]:
    """The spanning forest of the pairs below one task's shingles that might be links."""
    apart = _Apart(list(batches))
    forest = _Forest(len(apart.nodes))
    for a, b in apart.pairs(similarity):
        forest.link(apart.node[a], apart.node[b])
    yield _forest_of(apart, forest)


def _verify_clusters(_key, batches, similarity: float) -> Iterator[pa.RecordBatch]:
    """The spanning forest of the links in one task's clusters, and of the components that they join."""
    apart = _Apart(list(batches))
    held = [np.frombuffer(x.as_buffer(), "<u8") for x in apart.table.column("held").take(pa.array(apart.order))]
    fine = np.frombuffer(b"".join(bins(h, FINE_BINS) for h in held), np.uint8).reshape(len(held), -1)
    forest, some = _Forest(len(apart.nodes)), False
    firsts = np.unique(apart.root, return_index=True, return_inverse=True)[1:]
    forest.link(apart.node, apart.node[firsts[0][firsts[1]]])
    for a, b in apart.pairs(similarity):
        near = within_bins(fine, apart.n, a, b, similarity)
        a, b, size = a[near], b[near], 64
        while len(a):
            root = forest.roots()
            unlinked = root[apart.node[a]] != root[apart.node[b]]
            a, b = a[unlinked], b[unlinked]
            good = np.array([alike(held[x], held[y], similarity) for x, y in zip(a[:size].tolist(), b[:size].tolist(), strict=True)], bool)
            forest.link(apart.node[a[:size][good]], apart.node[b[:size][good]])
            some |= bool(good.any())
            a, b, size = a[size:], b[size:], min(2 * size, 4096)
    if some:
        yield _forest_of(apart, forest)


def _blocks(keyed: DataFrame) -> DataFrame:
    """Rows with a ``key`` of ``blocks`` blocks as pairs of blocks."""
    pairs = keyed.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    mine, other = F.col("block"), F.col("other")
    return pairs.select("key", F.least(mine, other).alias("i"), F.greatest(mine, other).alias("j"), (mine > other).cast("int").alias("side"), "root", "node", "n", "bins")


def missed_links(docs: DataFrame, entries: DataFrame, roots: DataFrame, words: int, similarity: float, unit: int = UNIT, again: bool = True) -> DataFrame:
    """Forests ``a, b`` of all links between texts of different components; ``roots`` has the component of every node that has one."""
    rows = entries.select("node", "n", "bins", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    keyed = rows.select("root", F.explode("first").alias("key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("here"), F.min("root").alias("least"), F.max("root").alias("most")).where(F.col("least") != F.col("most"))
    shared = materialize(shared.select("key", F.ceil(F.col("here") / unit).cast("int").alias("blocks"), "here"), "shared-shingles")
    total = shared.agg(F.sum(F.col("here") * F.col("blocks"))).collect()[0][0] or 0
    met = entries.select("node", F.explode("first").alias("key")).join(shared.drop("here"), "key")  # without the bins: most shingles go here
    met = _blocks(met.join(rows.drop("first"), "node"))
    met = _grouped(met, math.ceil(total / TASK_ROWS)).applyInArrow(_two(functools.partial(_clusters, similarity=similarity)), "a long, b long")
    cluster = materialize(components(materialize(met, "met")).withColumnRenamed("root", "key"), "clusters")
    sizes = cluster.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / unit).cast("int").alias("blocks"))
    sets = _sets_of(docs, entries, cluster.select("node"), words, again)
    placed = materialize(_blocks(rows.drop("first").join(cluster, "node").join(sizes, "key")), "placed-clusters")
    size = placed.agg(F.count(F.lit(1)).alias("rows"), F.sum(8 * F.col("n")).alias("bytes")).collect()[0]
    groups = max(math.ceil(size["rows"] / TASK_ROWS), math.ceil((size["bytes"] or 0) / TASK_BYTES))
    return _grouped(placed.join(sets, "node"), groups).applyInArrow(_two(functools.partial(_verify_clusters, similarity=similarity)), "a long, b long")


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("tie"))).alias("best")


def _placed(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """``node, best`` of ``entries``, the latter of the node's component."""
    placed = entries.select("node", "best").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    placed = materialize(placed, "placed")
    best = placed.groupBy("root").agg(F.min("best").alias("best"))
    return placed.select("node", "root").join(best, "root").select("node", "best")


def classes(prints: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """``fingerprint, component_id, best``: a row for each distinct fingerprint; ``best`` is the component's first document."""
    distinct = materialize(prints.groupBy(F.col("fingerprint").alias("fp")).agg(_first()), "fingerprints")
    placed = _placed(distinct.withColumnRenamed("fp", "node"), components(materialize(links(distinct.select("fp"), budget, unit), "forest")))
    return placed.select(F.col("node").alias("fingerprint"), F.col("best.doc_id").alias("component_id"), "best")


def report(docs: DataFrame, budget: int = BUDGET, unit: int = UNIT) -> DataFrame:
    """``doc_id, fingerprint`` (hexadecimal), ``component_id`` for every document."""
    prints = materialize(fingerprints(docs), "prints")
    with temporary(docs.sparkSession) as keep:
        found, path = store(classes(prints, budget, unit).select("fingerprint", "component_id"), "classes")
        keep(path)
    found = prints.join(found, "fingerprint")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, words: int = NEAR_WORDS, similarity: float = SIMILARITY, budget: int = NEAR_BUDGET, roots: int = ROOTS, unit: int = UNIT, blocks: int = BLOCKS) -> DataFrame:
    """The first document (smallest id) of every component of similar texts, with the columns of ``docs``."""
    with temporary(docs.sparkSession) as keep:
        schema = "doc_id long, tie long, node long, fp long, n long, roots array<long>, bins binary, first array<long>"
        work = functools.partial(_signatures, words=words, count=roots, similarity=similarity, common=common_shingles(docs, words))
        signed, written = store(map_arrow(_plain(docs), work, schema), "signatures")
        of_text = (F.first(c).alias(name) for c, name in (("fp", "fp"), ("n", "n"), ("roots", "prior"), ("bins", "bins"), ("first", "first")))
        entries = materialize(signed.groupBy("node").agg(_first(), *of_text), "texts")
        again = not signed.groupBy("doc_id", "tie").count().where(F.col("count") > 1).isEmpty()
        remove(docs.sparkSession, written)
        linked = materialize(components(materialize(near_links(docs, entries, words, similarity, budget, unit, blocks, again), "forest")), "linked")
        missed = materialize(missed_links(docs, entries, linked, words, similarity, unit, again), "missed")
        if not missed.isEmpty():
            linked = components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(missed))
        best = _placed(entries, linked).select("best").distinct()
        best, path = store(best.select(F.col("best.doc_id").alias("best_id"), F.col("best.tie").alias("best_tie")), "kept-ids")
        keep(path)
    held = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), tie().alias("tie"))
    kept = held.join(best, F.col("id").eqNullSafe(F.col("best_id")) & (F.col("tie") == F.col("best_tie")), "left_semi")
    if again:  # whole rows given more than once
        kept = kept.dropDuplicates(["id", "tie"])
    return kept.select("row.*")
