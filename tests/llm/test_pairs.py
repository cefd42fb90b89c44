"""SimHash near-duplicates and exact top-k: against brute force."""

import math
import os
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import components, simhash, topk
from tidemark.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, budget=2):
    u, inverse = np.unique(np.array(fps, np.uint64), return_inverse=True)
    parent = list(range(len(u)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= budget) + i + 1:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    roots = [find(int(k)) for k in inverse]
    best = {}
    for r, d in zip(roots, ids, strict=True):
        if d is not None:
            best[r] = min(best.get(r, d), d)
    return [best.get(r) for r in roots]


TEXTS = [None, "", " \n", "One", "one two", "ONE TWO three", "one two three", "é É ü", "a b c d e f g", "A B C D E F G", "x " * 30_000]


def test_fingerprints():
    for t in [*TEXTS, "Größe ÄÖ b\x0bc\x0cd\re", "nbsp\xa0word x y"]:
        assert simhash.fingerprint(t) == brute_fingerprint(t), repr(t)[:40]


def test_small_documents(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(3, "One", "x"), (None, "one", "x"), (None, "quite other words than these", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string").withColumns({c: F.lit("x") for c in ("tie", "best", "best_tie", "component_id", "fp")})
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.report(df).collect()}
    ids, fps = [r[0] for r in rows], [brute_fingerprint(r[1]) for r in rows]
    want = brute_components(fps, ids)
    assert got == {(d, f"{f:016x}"): c for d, f, c in zip(ids, fps, want, strict=True)}
    assert simhash.report(df.limit(0)).count() == 0


@pytest.mark.parametrize("unit", [8, 128, 1 << 11])
def test_crowds_of_near_copies(spark, unit):
    rng = np.random.default_rng(unit)
    center = rng.integers(0, 2**63, 2, dtype=np.uint64)
    near = [c ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (400, 2), dtype=np.uint64), axis=1) for c in center]
    fps = np.concatenate([*near, rng.integers(0, 2**63, 300, dtype=np.uint64), np.array([0, 1, 3, 7, 15, 2**63, 2**64 - 1], np.uint64), np.repeat(center[:1], 200)])
    prints = spark.createDataFrame([(i, 0, int(v)) for i, v in enumerate(fps.view(np.int64))], "doc_id long, tie long, fingerprint long")
    got = prints.join(simhash.classes(prints, unit=unit), "fingerprint").select("doc_id", "component_id").orderBy("doc_id").collect()
    assert [r.component_id for r in got] == brute_components(fps, range(len(fps)))


def test_forests_are_no_larger_than_their_nodes(spark):
    fps = [sum(1 << b for b in bits) for bits in [(i, j) for i in range(40) for j in range(i)]]  # all within 4, thousands within 2
    df = spark.createDataFrame([(v,) for v in fps], "fp long")
    tries = len(simhash.block_masks(len(fps), 2))
    assert simhash.links(df).count() < tries * len(fps)


@pytest.mark.parametrize("count", [10, 10**9, 10**12])
def test_every_near_pair_shares_a_root(count):
    masks = simhash.block_masks(count, 2)
    assert len(masks) == {10: 3, 10**9: 6, 10**12: 10}[count]
    for i in range(64):
        for j in range(i + 1):
            assert any(not (1 << i | 1 << j) & m for m in masks)


@pytest.mark.parametrize("budget", [0, 1, 2, 5, 18])
def test_walk_finds_every_pair_once(budget, monkeypatch):
    monkeypatch.setattr(simhash, "LEAF", 1)
    monkeypatch.setattr(simhash, "PAIRS", 50)
    rng = np.random.default_rng(budget)
    fp = np.sort(rng.integers(0, 2**16, 240, dtype=np.uint64) << np.uint64(44))
    parts = [np.sort(fp[a:b]) for a, b in ((0, 100), (100, 170), (170, 240))]
    held = np.concatenate(parts)
    got = [(int(i), int(j)) for a, b in simhash.walk(held, [0, 100], [100, 170], [0, 170], [100, 240], budget) for i, j in zip(a, b, strict=True)]
    near = lambda i, j: int(held[i] ^ held[j]).bit_count() <= budget
    want = [(i, j) for i in range(100) for j in range(i + 1, 100) if near(i, j)] + [(i, j) for i in range(100, 170) for j in range(170, 240) if near(i, j)]
    assert sorted(got) == sorted(want)


def brute_shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_groups(texts, similarity=0.8):
    """Components of texts by exact Jaccard similarity of their 5-word shingles, all pairs compared."""
    held = [brute_shingles(t) for t in texts]
    root = list(range(len(held)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(held)):
        for j in range(i):
            both = len(held[i] & held[j])
            if held[i] == held[j] or both >= similarity * (len(held[i]) + len(held[j]) - both) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(held))]


def changed(rng, words, n, vocabulary):
    at = rng.choice(len(words), n, replace=False)
    return [str(rng.choice(vocabulary)) if k in set(at.tolist()) else w for k, w in enumerate(words)]


@pytest.mark.parametrize(("unit", "blocks"), [(16, 1 << 20), (4, 1), (1 << 11, 32)])
def test_deduplicate_against_all_pairs(spark, unit, blocks):
    rng = np.random.default_rng(3)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choice(vocabulary, 60).tolist()
    texts = [*TEXTS, "a b c d e", "A  b c d\te"]
    for size in (60, 90, 300, 1500):
        for _ in range(8):
            base = rng.choice(vocabulary, size).tolist()
            texts += [" ".join(changed(rng, base, n, vocabulary)) for n in (0, 0, 1, max(1, size // 60), size // 40, size // 20)]
    crowd = rng.choice(vocabulary, 200).tolist()  # its copies are near it, but mostly not near each other
    texts += [" ".join(changed(rng, crowd, 4, vocabulary)) for _ in range(60)] + [" ".join(crowd)]
    texts += [" ".join(passage + rng.choice(vocabulary, 60).tolist()) for _ in range(40)]  # a shared passage is no copy
    want = brute_groups(texts)
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, best_id string, tie long, row int")
    got = simhash.deduplicate(df, unit=unit, blocks=blocks)
    assert got.columns == df.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(want))


@pytest.mark.parametrize(("roots", "budget", "unit", "blocks"), [(8, 18, 1 << 11, 32), (1, 0, 1 << 11, 32), (2, 3, 4, 1)])
def test_no_link_is_lost_to_roots_and_budget(spark, roots, budget, unit, blocks):
    """Pairs at 0.8 that differ in more than 18 bits or share none of the roots, beside crowds of copies and a passage that all share."""
    prints = lambda t: simhash.majority(simhash.shingles(t))
    ends = [(" ".join(f"p{k}w{i}" for i in range(13)), " ".join([*(f"p{k}w{i}" for i in range(12)), "end"])) for k in range(20_000)]
    far = [p for p in ends if (prints(p[0]) ^ prints(p[1])).bit_count() > 18][:4]
    assert far
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = rng.choice(vocabulary, 100).tolist()
    texts = [*TEXTS, *(t for pair in far for t in pair)]
    for size in (40, 100, 400):
        for _ in range(6):
            base = rng.choice(vocabulary, size).tolist()
            texts += [" ".join(changed(rng, base, n, vocabulary)) for n in (0, 1, size // 50 + 1, size // 40, size // 20)]
    texts += [" ".join(passage + rng.choice(vocabulary, int(n)).tolist()) for n in rng.integers(1, 60, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = simhash.deduplicate(df, roots=roots, budget=budget, unit=unit, blocks=blocks)
    assert sorted(r.doc_id for r in got.collect()) == sorted(set(brute_groups(texts)))


def test_similar_sets_share_a_first_shingle_and_pass_the_bins():
    rng = np.random.default_rng(6)
    common = rng.integers(0, 2**64, 50, dtype=np.uint64)
    order = (np.sort(common), np.arange(50) + 2)
    for size in [*range(1, 40), 300, 3000]:
        whole = np.unique(np.concatenate([rng.integers(0, 2**64, size, dtype=np.uint64), common[: size // 2]]))
        for lost in range(int(0.25 * len(whole)) + 1):
            mine, theirs = whole, np.sort(rng.permutation(whole)[lost:])
            if simhash.alike(mine, theirs, 0.8):
                assert set(simhash.first_shingles(mine, 0.8, order).tolist()) & set(simhash.first_shingles(theirs, 0.8, order).tolist())
                for count in (simhash.BINS, simhash.FINE_BINS):
                    counts = np.array([np.frombuffer(simhash.bins(h, count), np.uint8) for h in (mine, theirs)])
                    assert simhash.within_bins(counts, np.array([len(mine), len(theirs)]), np.array([0]), np.array([1]), 0.8).all()


def test_crowded_roots_are_parted(spark):
    """A shingle that all share: with the parting below it, hardly any two of them meet, but copies do, in one trie."""
    rows = [(i, i, 10, [7, *(1000 * j + (i // 2 if j < 4 else i) for j in range(1, 8))]) for i in range(400)]
    entries = spark.createDataFrame(rows, "node long, fp long, n long, prior array<long>")
    held = simhash.units(entries, F.col("prior"), unit=8, blocks=4, levels=3).collect()
    met = {}
    for r in held:
        met.setdefault((r.key, r.i, r.j), []).append(r)
    pairs = [(a.node, b.node, a.elsewhere) for group in met.values() for a in group for b in group if a.node < b.node]
    first = [(a, b) for a, b, skip in pairs if not any(skip >> k & 1 and rows[a][3][k] == rows[b][3][k] for k in range(8))]
    assert sorted(first) == [(i, i + 1) for i in range(0, 400, 2)] and len(held) < 3000


def test_deduplicate_odd_rows(spark):
    names = ("best_id", "best_tie", "_tie", "_best_id", "node", "row", "id", "fp", "a.b")
    rows = [(3, "One two"), (3, "One two"), (None, "one two"), (None, "other words"), (2, None), (7, ""), (7, "x " * 50_000), (9, "x " * 50_000 + "y")]
    df = spark.createDataFrame([(*r, *range(len(names))) for r in rows], "doc_id long, text string, " + ", ".join(f"`{n}` int" for n in names))
    got = simhash.deduplicate(df)
    assert got.columns == df.columns
    assert sorted(((r.doc_id, (r.text or "")[:11]) for r in got.collect()), key=str) == sorted([(3, "One two"), (None, "other words"), (2, ""), (7, "x x x x x x"), (9, "x x x x x x")], key=str)
    assert simhash.deduplicate(df.limit(0)).count() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(-5, 200), (200, 7), (300, 300)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[i] for i in range(51)} == {-5} and got[200] == -5 and {got[i] for i in range(100, 160)} == {100} and 300 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_near_duplicates_of_the_test_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").toPandas()
    got = QUERIES["op8_simhash_near_duplicates"](spark, DATA).toPandas().set_index("doc_id").loc[docs.doc_id]
    fps = [brute_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{f:016x}" for f in fps]
    assert got.component_id.tolist() == brute_components(fps, docs.doc_id.tolist())


def brute_top_k(rows, every, k=5):
    """Every row with a fitting id against every other row, in unbounded integers."""
    vectors = [(i, [math.floor(256 * float(c)) for c in v]) for i, v in rows]
    found = []
    for at, (q, x) in enumerate(vectors):
        if q % every == 0:
            scores = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(x, y, strict=False)))), i) for j, (i, y) in enumerate(vectors) if j != at]
            found += [(q, n + 1, i, -s) for n, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(found)


def ranked(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


@pytest.mark.parametrize("block", [3, 8192])
def test_top_k(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies of one vector: ties go to the smaller id
    rows += [(7, rows[9][1]), (50, rows[9][1]), (50, rows[50][1]), (2000, [0.0] * 8), (2050, [0.0] * 8)]  # ids given twice
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = topk.search(df, F.pmod("vec_id", F.lit(50)) == 0, query_block=block, sample_rows=64, pivots=5)
    assert ranked(got) == brute_top_k(rows, 50)


def test_most_annuli_of_clustered_vectors_stay_closed(spark, monkeypatch):
    monkeypatch.setattr(topk, "ANNULUS", 32)
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(40, 16))
    centers *= 4 / np.linalg.norm(centers, axis=1)[:, None]
    rows = [(i, (centers[i % 40] + rng.normal(size=16) / 50).tolist()) for i in range(8000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = topk.candidates(df, F.pmod("vec_id", F.lit(50)) == 0, query_block=40, pivots=40)
    assert topk.opened(found, 160, len(rows)) < 0.1
    read = found.where("query IS NULL").agg(F.sum("score")).collect()[0][0]  # what the ranges let into the tasks at all
    assert read < 0.5 * 160 * len(rows)
    x = np.floor(256 * np.array([r[1] for r in rows])).astype(np.int64)
    want = []
    for q in range(0, 8000, 50):
        score = x @ x[q]
        score[q] = -(2**62)
        want += [(q, n + 1, int(j), int(score[j])) for n, j in enumerate(np.lexsort((np.arange(8000), -score))[:5])]
    assert ranked(topk.best(found)) == want


def test_top_k_of_odd_vectors(spark):
    odd = [(1, None), (2, [float("nan"), 1.0]), (3, [None, 1.0]), (6, [float("inf"), 0.0]), (8, [1e300, 0.0]), (None, [1.0, 1.0]), (100, None)]
    good = [(0, [1.0, 2.0]), (4, [1.0]), (5, []), (50, [0.5, -0.501]), (51, [0.5, 0.5]), (51, [0.5, 0.5]), (0, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, "x") for r in odd + good], "vec_id long, embedding array<double>, score string").withColumns({c: F.lit(1) for c in ("at", "asked", "query", "pivot", "block")})
    assert ranked(topk.report(df)) == brute_top_k(good, 50)
    assert topk.report(df.limit(0)).count() == 0
    assert ranked(topk.report(spark.createDataFrame([(0, [])], "vec_id long, embedding array<double>"))) == []
    large = [(0, [1e7, 1.0]), (1, [1e7, 1.0]), (2, [1e7, 0.0]), (3, [2e9, 1.0]), (4, [3e15, 3e15]), (50, [-3e15, 1.0]), (5, [3e15, 0.0])]  # beyond 53 and 63 bits
    assert ranked(topk.report(spark.createDataFrame(large, "vec_id long, embedding array<double>"))) == brute_top_k(large, 50)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_top_k_of_the_test_data(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    assert ranked(QUERIES["op1_exact_top_k"](spark, DATA)) == brute_top_k(rows, 50)
