"""Chat formatting, quality rules and mixing against brute force on small odd inputs; all SQL oracles."""

import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat, mixing, quality
from tidemark.llm.queries import QUERIES, SQL

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
TEXTS = [
    None, "", "   \n\t", "one", "a b c", "a b c a b c", "a b c d a b c", "x x x x x x", "line\nline\n\nline\n  \n  ", "é ü ß 日本 # $ | <b>",
    " ".join(f"w{i}" for i in range(60)), " ".join(["same words here"] * 40), "\n".join(["dup line here"] * 6 + [f"other words {i} here" for i in range(20)]),
    " ".join(f"w{i}%%%" for i in range(60)), " ".join(f"CAPS{i}!" for i in range(60)), "a\x0bb\x0cc\rd", "nbsp\xa0inside word", " ".join(f"w{i % 700}" for i in range(20_000)),
]


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"s{i % 4}" if i % 5 else None, len(t or ""), "extra") for i, t in enumerate(TEXTS)]
    rows += [rows[4], (None, "null id words here", "en", "s1", 3, "extra")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept string").withColumns({c: F.col("kept") for c in ("size", "tie", "key", "range", "name", "target", "epoch", "failed_rule")}).cache()


def test_quality_statistics(docs):
    got = {r.doc_id: r for r in quality.report(docs).collect()}
    for i, t in enumerate(TEXTS):
        n = brute_quality(t)
        assert tuple(got[i][c] for c in quality.BASE) == n, repr(t)[:60]
        assert got[i].base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
        assert not (got[i].kept and got[i].base_failed)
    assert quality.report(docs).count() == docs.count()


def test_quality_verdicts_do_not_depend_on_the_order(docs):
    names = {r.doc_id: r.failed_rule for r in quality.judge(docs).collect()}
    assert names[10] is None and names[17] is not None
    kept = [r.doc_id for r in quality.keep(docs).collect()]
    assert kept == [i for i in names if names[i] is None]
    assert quality.keep(docs).columns == docs.columns
    for rules in (quality.RULES, quality.RULES[::-1]):
        assert sorted(r.doc_id for r in quality.keep(docs, rules).collect()) == sorted(kept)
    found = {r.doc_id: r.kept for r in quality.report(docs).collect()}
    assert all(found[i] == (names[i] is None) for i in names)


def test_quality_estimates_and_empty_tables(docs):
    best = quality.estimate(docs)
    assert {e.rule.name for e in best} == {r.name for r in quality.RULES}
    assert [e.rule.name for e in best] == [e.rule.name for e in quality.estimate(docs.repartition(3))]  # counts, not clocks
    left = best[0].left
    for e in best:
        assert e.left == left
        left -= e.rejected
    empty = docs.limit(0)
    assert quality.report(empty).count() == 0 and quality.keep(empty).count() == 0
    assert [e.rejected for e in quality.estimate(empty)] == [0] * len(quality.RULES)


def test_estimates_weigh_rejections_by_cost(spark):
    rows = spark.createDataFrame([(" ".join(f"w{k}" for k in range(100 + i)),) for i in range(400)], "text string")
    dear = quality.Rule("dear", ("n_repeat_words",), lambda s: s["n_repeat_words"] >= 0)
    cheap = quality.Rule("cheap", ("n_words",), lambda s: s["n_words"] % 2 == 0)
    again = quality.Rule("again", ("n_words",), lambda s: s["n_words"] % 7 == 0)
    got = quality.estimate(rows, (dear, again, cheap))
    # half for one pass over the text, then what is free once its statistic is there, then the dear one
    assert [e.rule.name for e in got] == ["cheap", "again", "dear"] and got[0].cost > 10 * got[1].cost


def test_cascade_stops_at_the_first_rejection(spark):
    fails = F.raise_error(F.lit("evaluated")).cast("long")
    late = quality.Rule("late", ("n_capitals",), lambda s: s["n_capitals"] > 0)
    held = quality.STATISTICS["n_capitals"]
    quality.STATISTICS["n_capitals"] = quality.Statistic(lambda text: fails, 1.0)
    try:
        found = spark.createDataFrame([("short",)], "text string").select(quality.cascade([quality.MIN_WORDS, late], F.col("text")).alias("r"))
        assert found.collect()[0].r == "min_words"
        with pytest.raises(Exception, match="evaluated"):
            spark.createDataFrame([("long " * 60,)], "text string").select(quality.cascade([quality.MIN_WORDS, late], F.col("text")).alias("r")).collect()
    finally:
        quality.STATISTICS["n_capitals"] = held


def brute_targets(sizes, weights=(3, 1, 2), budget=1.5):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if left * weight[s] / total > 2 * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


@pytest.mark.parametrize("rows_per_range", [1, 3, 4096])
def test_mixing_reaches_its_targets(docs, rows_per_range):
    sizes = {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + len(WORD.findall(r.text or ""))
    want = brute_targets(sizes)
    rows = mixing.assign(docs, rows_per_range=rows_per_range).collect()
    assert len(rows) == docs.count()
    taken = Counter()
    for r in rows:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source]
        assert 0 <= r.taken <= 2 * r.size and (r.position_1 is None) == (r.take_1 == 0)
        assert all(p is None or 0 <= p <= 1 for p in (r.position_1, r.position_2))
        taken[r.source] += r.taken
    assert all(taken[s] == int(want[s] + 1e-9) for s in want)
    again = mixing.assign(docs, rows_per_range=rows_per_range).select("doc_id", "size", "taken", "position_1").collect()
    assert sorted(map(repr, again)) == sorted(repr(r) for r in mixing.assign(docs, rows_per_range=7).select("doc_id", "size", "taken", "position_1").collect())


def test_mix_is_in_training_order_and_cuts_texts(docs):
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    whole = {r.doc_id: r.text for r in docs.collect()}
    words = 0
    for r in mixed.collect():
        assert whole[r.doc_id].startswith(r.text) and (r.key, r["size"], r.epoch) == ("extra",) * 3
        assert r.text == whole[r.doc_id] or r.n_chars == len(r.text)
        words += len(WORD.findall(r.text))
    assert words == sum(r.taken for r in mixing.assign(docs).collect())
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.report(docs.limit(0)).count() == 0


def test_schedules_are_inverted(spark):
    knots = ((0.0, 0.0), (0.25, 2.0), (0.5, 0.0), (0.75, 1.0), (1.0, 1.0))
    shares = [i / 100 for i in range(101)]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in shares], "s double").select(mixing.time_of(F.col("s"), knots)).collect()]

    def area(t):
        total = 0.0
        for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
            if t > t0:
                e = min(t, t1)
                w = w0 + (w1 - w0) * (e - t0) / (t1 - t0)
                total += (w0 + w) / 2 * (e - t0)
        return total

    assert all(area(t) / area(1.0) == pytest.approx(s, abs=1e-9) for s, t in zip(shares, got, strict=True))


@pytest.mark.parametrize("n", [0, 1, 2, 5, 99])
def test_first_words(spark, n):
    for t in [t for t in TEXTS if t]:
        got = spark.createDataFrame([(t,)], "t string").select(mixing.first_words(F.col("t"), F.lit(n))).collect()[0][0]
        ends = [m.end() for m in WORD.finditer(t)][:n]
        assert got == (t if len(ends) < n else t[: ends[-1]] if ends else "")


def test_preference_pairs(spark):
    def turn(c, i, role, text):
        return (c, i, role, text, "x")

    rows = [
        turn(0, 0, "system", "S"), turn(0, 1, "user", "Q"), turn(0, 2, "assistant", "good"), turn(0, 2, "assistant", "good"),
        turn(1, 0, "system", "S"), turn(1, 1, "user", "Q"), turn(1, 2, "assistant", "bad"), turn(1, 3, "user", "ok"),
        turn(2, 0, "user", "same"), turn(3, 0, "user", "same"),
        turn(4, 0, None, None), turn(None, 0, "user", "dropped"), turn(7, 5, "user", "alone"),
        turn(8, 0, "user", "a"), turn(9, 0, "user", "b"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, prompt string")
    got = {r.pair_id: r for r in chat.preference_pairs(df).collect()}
    assert set(got) == {0, 1, 2, 3, 4}
    p = got[0]
    assert (p.n_prompt_turns, p.prompt) == (2, "<|system|>\nS<|end|>\n<|user|>\nQ<|end|>\n")
    assert p.chosen == "<|assistant|>\ngood<|end|>\n" and p.chosen_mask == [14, 12]
    assert p.rejected == "<|assistant|>\nbad<|end|>\n<|user|>\nok<|end|>\n" and p.rejected_mask == [14, 11, 19, 0]
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected, got[1].chosen_mask) == (1, "", "", [])
    assert (got[2].prompt, got[2].chosen, got[2].rejected) == ("", "<|unknown|>\n<|end|>\n", None)
    assert got[3].chosen is None and got[3].rejected_mask == [len("<|user|>\nalone<|end|>\n"), 0]
    assert got[4].n_prompt_turns == 0
    for r in got.values():
        for s in ("chosen", "rejected"):
            assert r[s] is None or sum(r[f"{s}_mask"]) == len(r[s])
    assert chat.preference_pairs(df.limit(0)).count() == 0


def test_contrast_pairs(spark):
    rows = [
        (0, 0, "system", "S"), (0, 1, "user", "Q"), (0, 2, "assistant", "mine"), (0, 3, "user", "thanks"),
        (1, 0, "user", "P"), (1, 1, "assistant", "early"), (1, 2, "user", "R"), (1, 3, "assistant", "theirs"), (1, 3, "assistant", "theirs"),
        (2, 0, "user", "U"), (2, 1, "assistant", "same"), (3, 0, "assistant", "same"),
        (4, 0, "user", "no answer"), (5, 0, "assistant", "an answer"), (7, 0, "assistant", "x" * 500_000), (None, 0, "assistant", "dropped"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("a", "b", "pair_id", "n", "side")})
    got = {r.pair_id: r for r in chat.contrast_pairs(df).collect()}
    assert set(got) == {0, 1, 2, 3, 4, 5, 7}
    said = lambda role, text: f"<|{role}|>\n{text}<|end|>\n"
    assert (got[0].n_prompt_turns, got[0].prompt) == (2, said("system", "S") + said("user", "Q"))
    assert (got[0].chosen, got[0].rejected) == (said("assistant", "mine") + said("user", "thanks"), said("assistant", "theirs"))
    assert (got[0].chosen_mask, got[0].rejected_mask) == ([14, 12, 23, 0], [14, 14])
    assert (got[1].n_prompt_turns, got[1].chosen, got[1].rejected) == (3, said("assistant", "theirs"), said("assistant", "mine"))
    assert (got[2].n_prompt_turns, got[2].chosen, got[2].rejected, got[2].rejected_mask) == (2, "", "", [])
    assert (got[3].n_prompt_turns, got[3].prompt) == (1, said("assistant", "same"))
    for k in (4, 5, 7):
        assert (got[k].n_prompt_turns, got[k].prompt, got[k].rejected, got[k].rejected_mask) == (0, "", None, None)
    assert got[4].chosen == said("user", "no answer") and len(got[7].chosen) > 500_000
    assert chat.contrast_pairs(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_conversations_of_the_test_data_have_prompts(spark):
    turns = sorted((r.conv_id, r.turn, r.role) for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect())
    roles = {}
    for i, _, role in turns:
        roles.setdefault(i, []).append(role)
    answered = {i for i, held in roles.items() if "assistant" in held[1:] and "assistant" in roles.get(i ^ 1, ())}
    got = {r.pair_id: r for r in QUERIES["op2_preference_formatting"](spark, DATA).collect()}
    assert set(got) == set(roles) and len(answered) > 5 and all(got[i].prompt.startswith("<|") and got[i].rejected is not None for i in answered)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(SQL))
def test_oracles(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = QUERIES[name](spark, DATA)
    cursor = con.execute(SQL[name])
    given = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert columns == sorted(given)
    want = sorted(repr(tuple(r[given.index(c)] for c in columns)) for r in cursor.fetchall())
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == want


def test_mixing_query_comes_in_training_order(spark):
    got = [(r.position_1, r.position_2) for r in QUERIES["op6_source_mixing"](spark, DATA).collect()]
    placed = [a for a, _ in got if a is not None]
    assert placed and placed == sorted(placed) and all(a is None for a, _ in got[len(placed) :])
    assert all(b is None or a < b for a, b in got) and any(b for _, b in got)


def test_positions_follow_the_schedules(spark):
    """Of a fading source more than half of the words lie in the first half, as its integral says."""
    rows = [(i, f"s{i % 3}", f"word{i} " * (1 + i % 9)) for i in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    due, seen = {}, {}
    for r in mixing.assign(df).collect():
        for k in (1, 2):
            if r[f"take_{k}"]:
                seen[r.source] = seen.get(r.source, 0) + (r[f"take_{k}"] if r[f"position_{k}"] < 0.5 else 0)
        due[r.source] = r.target
    assert {s: seen[s] / due[s] for s in due} == pytest.approx({"s0": 0.625, "s1": 0.5, "s2": 0.375}, abs=0.01)  # (1.5 + 1) / 4, ...


def test_null_ids_are_spread(spark):
    df = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("s").alias("source"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    ranges = mixing.placed(mixing.sized(df), 0, mixing.SCHEDULES, 64).groupBy("range").count().collect()
    assert len(ranges) > 32 and max(r["count"] for r in ranges) < 200


def test_mixing_leaves_columns_of_any_name_alone(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 99, 1, "x") for i in range(20)], "doc_id long, text string, source string, _mix_size long, position int, `a.b` string")
    assert {(r["_mix_size"], r.position, r["a.b"]) for r in mixing.mix(df).collect()} == {(99, 1, "x")}
    assert {(r["_mix_size"], r["size"]) for r in mixing.assign(df).collect()} == {(99, 3)}
