"""Quality rules as a short-circuit cascade (DataFrame functions only).

Each rule is a rejection test on text statistics. A bounded sample gives every rule's cost (the
characters that its statistics read, by the work each takes for a character) and selectivity (the
documents that it rejects); the cascade takes, again and again, the rule that rejects most of what is
left for its cost, statistics that an earlier rule has computed being free. The order decides how
much work is done, never which documents stay: a document is kept if no rule rejects it. The
estimates are counts, so the same table always gives the same order.

The cascade is one expression: a statistic is computed when the first rule that needs it is reached,
is bound there for all later rules, and is not computed for a document that is already rejected.
No operator here shuffles; a document is judged by the task that reads it.

Defined results for odd input: a null or blank text has no words and is rejected by ``min_words``;
repeated rows and rows with a null ``doc_id`` are judged like all others, each by itself; an empty
table gives an empty result; an input column named like an added one is replaced.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm._shared import WORD, let, text_or_empty

SYMBOLS = "#*$%&|<>"
SPACE = r"\x20\x09-\x0D"
WINDOW = 3
#: Rows of the sample that costs and selectivities are estimated on.
SAMPLE_ROWS = 500


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(words: Column) -> Column:
    """Code points in words."""
    return F.length(F.array_join(words, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long")


def n_lines(text: Column) -> Column:
    """Lines that hold a word."""
    return F.size(_lines(text)).cast("long")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{SPACE}]"))


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(words: Column) -> Column:
    """Words covered by windows of three words that the text has twice or more.

    Window hashes show cheaply that nothing repeats; else the windows themselves are sorted with
    their positions, equal neighbours mark repeated windows, and a fold over the marked positions
    counts the words they cover.
    """

    def window(words: Column, i: Column) -> Column:
        return F.concat_ws(" ", *(F.get(words, i + k) for k in range(WINDOW)))

    def starts(words: Column) -> Column:
        return F.sequence(F.lit(0), F.size(words) - WINDOW)

    def hashes(words: Column) -> Column:
        # The last two, which run out of words, only add two values that no window has.
        return F.transform(words, lambda word, i: F.xxhash64(word, *(F.get(words, i + k) for k in range(1, WINDOW))))

    def repeats(words: Column) -> Column:
        return let(hashes(words), lambda h: F.size(F.array_distinct(h)) < F.size(h))

    def placed(words: Column) -> Column:
        return F.sort_array(F.transform(starts(words), lambda i: F.struct(window(words, i).alias("w"), i.alias("i"))))

    def marked(p: Column) -> Column:
        def same(x: Column, k: Column) -> Column:
            return F.coalesce(F.get(p, k)["w"] == x["w"], F.lit(False))

        return F.transform(F.filter(p, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"])

    def covered(positions: Column) -> Column:
        start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
        return F.aggregate(
            F.sort_array(positions),
            start,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    found = F.when((F.size(words) > WINDOW) & repeats(words), let(placed(words), lambda p: covered(marked(p)))).otherwise(0)
    return found.cast("long")


def n_capitals(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long")


@dataclass(frozen=True)
class Statistic:
    """``of`` the text, or of its words; ``work``: what it takes for a character of text, as a multiple of a plain pattern count."""

    of: Callable[[Column], Column]
    work: float
    from_words: bool = False


#: Stands for the array of words among what is bound; taking a text apart is the work of this many pattern counts.
WORDS = "words"
WORDS_WORK = 1.5

STATISTICS: dict[str, Statistic] = {
    "n_words": Statistic(n_words, 0.0, True),
    "word_chars": Statistic(word_chars, 0.3, True),
    "n_symbols": Statistic(n_symbols, 1.0),
    "n_lines": Statistic(n_lines, 1.5),
    "n_dup_lines": Statistic(n_dup_lines, 2.0),
    "n_repeat_words": Statistic(n_repeat_words, 4.0, True),
    "n_capitals": Statistic(n_capitals, 1.0),
}
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """``rejects`` builds a boolean column from the statistics that it ``needs``, given by name."""

    name: str
    needs: tuple[str, ...]
    rejects: Callable[[Mapping[str, Column]], Column]


MIN_WORDS = Rule("min_words", ("n_words",), lambda s: s["n_words"] < 50)
REPEATS = Rule("repeats", ("n_repeat_words", "n_words"), lambda s: 100 * s["n_repeat_words"] > 50 * s["n_words"])
#: The two rules of ``base_failed``.
BASE_RULES = (MIN_WORDS, REPEATS)
RULES = (
    *BASE_RULES,
    Rule("symbols", ("n_symbols", "n_words"), lambda s: 100 * s["n_symbols"] > 30 * s["n_words"]),
    Rule("duplicate_lines", ("n_dup_lines", "n_lines"), lambda s: (s["n_dup_lines"] >= 4) & (100 * s["n_dup_lines"] > 30 * s["n_lines"])),
    Rule("word_length", ("word_chars", "n_words"), lambda s: (s["word_chars"] < 2 * s["n_words"]) | (s["word_chars"] > 20 * s["n_words"])),
    Rule("shouting", ("n_capitals", "word_chars"), lambda s: 100 * s["n_capitals"] > 50 * s["word_chars"]),
)


@dataclass(frozen=True)
class Estimate:
    """Of a rule at its place in the order: the work on the sample's documents that are left there, and how many of them it rejects."""

    rule: Rule
    cost: float
    rejected: int
    left: int


def estimate(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, known: tuple[str, ...] = ()) -> list[Estimate]:
    """The rules in the order of the cascade, by at most ``sample_rows`` documents; the statistics in ``known`` are free.

    The sample is drawn by a hash of the text, from as few partitions as hold enough rows; of each of
    its documents one number and one flag per rule come to the driver. Equal gains keep the given order.
    """
    text = F.col("text")
    picked = docs.select(text_or_empty().alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(8)) == 0).limit(sample_rows)
    names = dict.fromkeys(n for rule in rules for n in rule.needs)
    held = picked.withColumn(WORDS, words_of(text)).select(F.length(text).alias("chars"), *(_statistic(n, text, F.col(WORDS)).alias(n) for n in names))
    flags = [F.coalesce(rule.rejects({n: F.col(n) for n in rule.needs}), F.lit(False)) for rule in rules]
    left = [(r["chars"] + 1, r["flags"]) for r in held.select("chars", F.array(*flags).alias("flags")).collect()] if rules else []
    there, open_, found = set(known), list(range(len(rules))), []
    while open_:
        chars = sum(c for c, _ in left)

        def gain(k: int) -> tuple[int, float]:
            missing = [STATISTICS[n] for n in rules[k].needs if n not in there]
            work = sum(s.work for s in missing) + (WORDS_WORK if WORDS not in there and any(s.from_words for s in missing) else 0)
            return sum(f[k] for _, f in left), (work + 0.01) * chars  # noqa: B023

        # Most rejections for the cost first; rules that reject nothing by cost.
        best = max(open_, key=lambda k: (gain(k)[0] / max(gain(k)[1], 1.0), -gain(k)[1], -k))  # noqa: B023
        found.append(Estimate(rules[best], gain(best)[1], gain(best)[0], len(left)))
        left = [x for x in left if not x[1][best]]
        there |= {*rules[best].needs, *(WORDS for n in rules[best].needs if STATISTICS[n].from_words)}
        open_.remove(best)
    return found


def _statistic(name: str, text: Column, words: Column) -> Column:
    return STATISTICS[name].of(words if STATISTICS[name].from_words else text)


def cascade(order: Sequence[Rule], text: Column, known: Mapping[str, Column] | None = None) -> Column:
    """Name of the first rule of ``order`` that rejects, else null; what only later rules need is not computed."""
    known = dict(known or {})
    if not order:
        return F.lit(None).cast("string")
    rule, rest = order[0], order[1:]
    missing = [n for n in rule.needs if n not in known]

    def verdict(bound: Mapping[str, Column]) -> Column:
        return F.when(F.coalesce(rule.rejects(bound), F.lit(False)), F.lit(rule.name)).otherwise(cascade(rest, text, bound))

    if not missing:
        return verdict(known)
    if WORDS not in known and any(STATISTICS[n].from_words for n in missing):
        return let(words_of(text), lambda words: cascade(order, text, known | {WORDS: words}))
    return let(F.struct(*(_statistic(n, text, known.get(WORDS, text)).alias(n) for n in missing)), lambda s: verdict(known | {n: s[n] for n in missing}))


def _order(docs: DataFrame, rules: tuple[Rule, ...], sample_rows: int, known: tuple[str, ...] = ()) -> list[Rule]:
    return [e.rule for e in estimate(docs, rules, sample_rows, known)]


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``docs`` with ``failed_rule`` (null: none) and ``kept``."""
    verdict = cascade(_order(docs, rules, sample_rows), text_or_empty())
    return docs.withColumn("failed_rule", verdict).withColumn("kept", F.col("failed_rule").isNull())


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that no rule rejects, with the columns of ``docs``."""
    return docs.where(cascade(_order(docs, rules, sample_rows), text_or_empty()).isNull())


def report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The base statistics of every document, ``base_failed`` and the cascade's verdict ``kept``.

    The base statistics are wanted for every row; the other rules follow in the order of the cascade, for the
    documents that pass the base rules only, and so do the statistics that only they need.
    """
    order = _order(docs, tuple(r for r in RULES if r not in BASE_RULES), sample_rows, BASE)
    text = F.col("text")
    taken = docs.select("doc_id", text_or_empty().alias("text"))
    bound = let(words_of(text), lambda words: F.struct(*(_statistic(n, text, words).alias(n) for n in BASE)))
    stats = taken.withColumn("base", bound).select("doc_id", "text", "base.*")
    known = {n: F.col(n) for n in BASE}
    judged = stats.withColumn("base_failed", reduce(Column.__or__, (r.rejects(known) for r in BASE_RULES)))
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(cascade(order, text, known).isNull())
    return judged.select("doc_id", *BASE, "base_failed", kept.alias("kept"))
