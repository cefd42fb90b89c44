"""Preference formatting (DataFrame functions only).

A pair has a chosen and a rejected conversation. The longest common prefix of their turns (equal role
and text) is rendered once as the prompt; what follows on each side is its completion, rendered
with a loss mask.

Two ways to pairs: :func:`preference_pairs` takes conversations ``2k`` and ``2k + 1`` as the sides of pair
``k``. :func:`contrast_pairs`, for tables of conversations that were never judged, gives every conversation
a rejected side of its own: the same turns up to its last answer, and there the last answer of
its neighbour (``2k`` and ``2k + 1`` are neighbours).

A turn renders as ``<|role|>\\n`` + text + ``<|end|>\\n``. A mask holds alternating run lengths in
code points, masked first: headers and turns of others are masked, the text and end mark of an
assistant's turn are trained on. There is one shuffle, by pair; a pair's turns meet in one row
because that row is the result. Equal openings or whole conversations shared by many pairs stay
spread over their pairs.

Defined results for odd input: rows without ``conv_id`` take no part; equal rows count once; turns
with the same number are ordered by role, then text, and a null number comes first; a null role
reads ``unknown``, a null text is empty; if one side is missing (for a contrast: if a conversation or its
neighbour has no answer) the prompt is empty and the missing side's completion and mask are null; two
equal sides give empty completions; an empty table gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _body(turn: Column) -> Column:
    return F.concat(turn["text"], F.lit("<|end|>\n"))


def render(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(_header(t), _body(t))), "")


def mask(turns: Column) -> Column:
    """Alternating lengths of masked and trained runs, two for each turn."""

    def runs(t: Column) -> Column:
        header, body = F.length(_header(t)).cast("long"), F.length(_body(t)).cast("long")
        trained = t["role"] == TRAINED_ROLE
        return F.array(F.when(trained, header).otherwise(header + body), F.when(trained, body).otherwise(F.lit(0).cast("long")))

    return F.flatten(F.transform(turns, runs))


def common_prefix(a: Column, b: Column) -> Column:
    """Number of leading turns that are equal in role and text."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce((x["role"] == y["role"]) & (x["text"] == y["text"]), F.lit(False)))
    differs = F.array_position(same, False)
    return F.when(differs == 0, F.size(same)).otherwise(differs - 1).cast("int")


def _conversations(conversations: DataFrame) -> DataFrame:
    """``pair_id`` and the turns of its two conversations, ``a`` (even) and ``b`` (odd), in order."""
    turn = F.struct(
        F.col("turn"),
        F.coalesce(F.col("role"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    side = F.pmod(F.col("conv_id"), F.lit(2))
    return (
        conversations.where(F.col("conv_id").isNotNull())
        .select(F.shiftright("conv_id", 1).alias("pair_id"), side.alias("side"), turn.alias("turn"))
        .groupBy("pair_id")
        .agg(*(F.sort_array(F.collect_set(F.when(F.col("side") == k, F.col("turn")))).alias(name) for k, name in enumerate(("a", "b"))))
    )


def formatted(pairs: DataFrame) -> DataFrame:
    """``pair_id, a, b`` (turns of the chosen and the rejected side; none: missing) as prompt, completions and masks."""
    whole = (F.size("a") > 0) & (F.size("b") > 0)
    split = pairs.withColumn("n", F.when(whole, common_prefix(F.col("a"), F.col("b"))).otherwise(0))
    rest = {"chosen": F.slice("a", F.col("n") + 1, F.size("a")), "rejected": F.slice("b", F.col("n") + 1, F.size("b"))}
    there = {"chosen": F.size("a") > 0, "rejected": F.size("b") > 0}
    return split.select(
        "pair_id",
        F.col("n").cast("long").alias("n_prompt_turns"),
        render(F.slice("a", F.lit(1), F.col("n"))).alias("prompt"),
        *(F.when(there[s], render(rest[s])).alias(s) for s in rest),
        *(F.when(there[s], mask(rest[s])).alias(f"{s}_mask") for s in rest),
    )


def preference_pairs(conversations: DataFrame) -> DataFrame:
    """One row for each two conversations ``2k`` and ``2k + 1``: prompt, and completion and mask of either side."""
    return formatted(_conversations(conversations))


def _last_answer(turns: Column) -> Column:
    """Its position from 0; null: none."""
    return F.array_max(F.transform(turns, lambda t, i: F.when(t["role"] == TRAINED_ROLE, i)))


def contrast_pairs(conversations: DataFrame) -> DataFrame:
    """One row for each conversation, its number being ``pair_id``: itself against its neighbour's last answer."""

    def contrast(mine: Column, theirs: Column, side: int) -> Column:
        other = F.concat(F.slice(mine, F.lit(1), _last_answer(mine)), F.array(F.get(theirs, _last_answer(theirs))))
        known = _last_answer(mine).isNotNull() & _last_answer(theirs).isNotNull()
        return F.struct((2 * F.col("pair_id") + side).alias("pair_id"), mine.alias("a"), F.when(known, other).otherwise(F.slice(mine, 1, 0)).alias("b"))

    both = F.array(contrast(F.col("a"), F.col("b"), 0), contrast(F.col("b"), F.col("a"), 1))
    pairs = _conversations(conversations).select(F.inline(F.filter(both, lambda p: F.size(p["a"]) > 0)))
    return formatted(pairs)
