"""The pipeline against a brute-force version of every stage on what the stage before has kept."""

import os
from collections import Counter

import pytest

import corpus_pipeline
from tests.llm.test_native import WORD, brute_quality, brute_targets
from tests.llm.test_pairs import brute_groups
from tests.llm.test_tokens import ids_of
from tidemark.llm import quality, toxicity
from tidemark.llm._shared import materialize

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def kept(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(materialize(stage(spark, tables[-1], DATA), name))
    return tables


def test_stages_keep_the_columns(kept):
    assert all(t.columns == kept[0].columns for t in kept[:5])
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity_chain", "simhash_near_dedup", "source_mixing", "packing"]


def test_rules(kept):
    after = {r.doc_id for r in kept[1].collect()}
    for r in kept[0].collect():
        words, chars, symbols, dup, repeats = brute_quality(r.text)
        lines = sum(1 for x in r.text.split("\n") if WORD.search(x))
        bad = (words < 50 or 100 * repeats > 50 * words or 100 * symbols > 30 * words or (dup >= 4 and 100 * dup > 30 * lines)
               or chars < 2 * words or chars > 20 * words or 100 * sum(c.isupper() for c in r.text) > 50 * chars)
        assert (r.doc_id in after) != bad


def test_toxicity(kept, spark):
    chain = toxicity.fit(kept[1], spark.read.parquet(f"{DATA}/labels.parquet"))
    want = {r.doc_id for r in kept[1].collect() if chain.probabilities(toxicity.features(r.text))[-1] < chain.thresholds[-1]}
    assert {r.doc_id for r in kept[2].collect()} == want


def test_duplicates(kept):
    docs = sorted(kept[2].collect(), key=lambda r: r.doc_id)
    roots = set(brute_groups([r.text for r in docs]))
    assert sorted(r.doc_id for r in kept[3].collect()) == [r.doc_id for k, r in enumerate(docs) if k in roots]


def test_mix(kept):
    whole = {r.doc_id: r for r in kept[3].collect()}
    sizes, taken = Counter(), Counter()
    for r in whole.values():
        sizes[r.source] += len(WORD.findall(r.text))
    times = Counter()
    for r in kept[4].collect():
        assert whole[r.doc_id].text.startswith(r.text)
        taken[r.source] += len(WORD.findall(r.text))
        times[r.doc_id] += 1
    want = brute_targets(sizes)
    assert all(taken[s] == int(want[s] + 1e-9) for s in sizes) and max(times.values()) <= 2


def test_packed(kept, spark):
    rows = kept[5].collect()
    assert sum(r.length for r in rows) == sum(len(ids_of(r.text)) for r in kept[4].collect())
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()) == Counter(r.doc_id for r in rows)
    assert len(quality.RULES) == 6


def test_run_frees_what_the_stages_wrote(spark):
    from tidemark.sources import scratch

    before = set(scratch._made)
    assert corpus_pipeline.run(spark, DATA).count() > 0
    left = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in scratch._made if p not in before and os.path.isdir(p.removeprefix("file://"))]
    assert sorted(left) == ["stage-source_mixing", "tokens"]


def test_stages_take_nulls_clashing_columns_and_empty_tables(spark):
    long = " ".join(f"word{k}" for k in range(60_000))
    prose = " ".join(f"plain{k % 211} text{k % 97}" for k in range(60))
    rows = [(1, long), (2, long), (3, prose), (None, prose + " more"), (4, None), (None, None), (5, ""), (6, prose), (6, prose), (7, "x" * 100_000)]
    names = ("row", "size", "key", "tie", "node", "position", "failed_rule", "kept", "part", "file")
    docs = spark.createDataFrame([(i, t, None, None if i == 3 else "s", len(t or ""), *names) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    for table in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            after = stage(spark, table, DATA)
            assert after.columns == docs.columns
            table = materialize(after, "odd")
            assert all(tuple(r)[5:] == names for r in table.collect())
        assert corpus_pipeline.STAGES[4][1](spark, table, DATA).count() >= table.count()
