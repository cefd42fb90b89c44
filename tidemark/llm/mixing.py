"""Mixing sources to target weights as a time-varying curriculum (DataFrame functions only).

Targets: the sources in code-point order (null last) weigh 3, 1, 2, repeating. Their targets share
``budget`` times all words by weight; a target stops at ``max_epochs`` times its source's size and
the excess goes to the others by weight. In order of capacity per weight the capped sources come
first, so the water level is found with prefix sums over one row per source.

Positions: every source has a schedule, a piecewise-linear weight over training time 0..1. Its
integral says which share of the source's target is due by a time; the inverse of that integral
takes a document's place in the source's cumulative demand to a time, its training position.
The documents of a source come in the order of a keyed hash of their id and text. A second epoch
repeats that order. The document at which the target is reached is cut after its last word taken.

Offsets are two-pass prefix sums: sizes by (source, hash range), then running sums of the ranges
of a source (in two levels) and of the documents in a range. The number of ranges follows the number
of documents, so a source that holds a third of all rows is spread over all of them.

Defined results for odd input: a null text has no words, and documents without words have size and
taken 0 and no position; null ids and ids given many times are told apart by their texts; repeated rows
are documents of their own; an empty table gives an empty result; an input column named like one that
:func:`assign` adds is replaced; all others come back, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm._shared import SPACES, count_words, materialize, text_or_empty

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MAX_EPOCHS = 2
#: By a source's place in the weights: (time, weight) knots. The first fades out, the last in.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (1.0, 1.5)))
ROWS_PER_RANGE = 512
#: Hash digits (hexadecimal) that order the documents of a source.
DIGITS = 15


def order_key(seed: int) -> Column:
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text_or_empty()).cast("binary"))
    return F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``source, source_size`` with ``place`` (its index in the weights) and ``target``; one row per source."""
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    rank = F.row_number().over(by_name) - 1
    place = F.pmod(rank, F.lit(len(weights)))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") + 1).cast("int"))
    rows = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("cap", (max_epochs * F.col("source_size")).cast("double"))
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), "source")
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    onward = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    rest = F.lit(budget) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = rows.withColumn("level", rest / F.sum("weight").over(onward))
    # The first source, in filling order, whose capacity is not below its share sets the level for all from there on.
    open_ = F.col("cap") >= F.col("weight") * F.col("level")
    set_at = F.first(F.when(open_, F.col("level")), ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    share = F.col("weight") * set_at
    return level.select("source", "source_size", "place", F.when(set_at.isNull(), F.col("cap")).otherwise(share).alias("target"))


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time by which ``share`` of a schedule's integral is reached."""
    areas = [0.0]
    for (t0, w0), (t1, w1) in zip(knots, knots[1:], strict=False):
        areas.append(areas[-1] + (w0 + w1) / 2 * (t1 - t0))
    due = share * F.lit(areas[-1])
    time = F.lit(knots[-1][0])
    for i in reversed(range(len(knots) - 1)):
        (t0, w0), (t1, w1) = knots[i], knots[i + 1]
        part = F.greatest(due - F.lit(areas[i]), F.lit(0.0))
        root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0) / (t1 - t0)) * part, F.lit(0.0)))
        within = F.lit(t0) + F.when(part > 0, 2 * part / (F.lit(w0) + root)).otherwise(0.0)
        time = F.when(due <= F.lit(areas[i + 1]), F.least(within, F.lit(t1))).otherwise(time)
    return time


def _overlap(start: Column, size: Column, end: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), F.least(start + size, end) - start)


def _running(ranges: DataFrame) -> DataFrame:
    """What precedes each range within its source: over coarse ranges, and over the ranges in one of them."""

    def before(keys: list[str], order: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("range_size").over(window), F.lit(0))

    coarse = ranges.groupBy("name", "coarse").agg(F.sum("range_size").alias("range_size"))
    coarse = coarse.select("name", "coarse", before(["name"], "coarse").alias("above"))
    fine = ranges.select("name", "coarse", "range", before(["name", "coarse"], "range").alias("within"))
    return fine.join(coarse, ["name", "coarse"]).select("name", "range", (F.col("above") + F.col("within")).alias("base"))


def sized(docs: DataFrame, seed: int = 0, whole: bool = False) -> DataFrame:
    """What places a document: ``doc_id, source, size, key``; with ``whole``, also its ``row``."""
    row = [F.struct("*").alias("row")] if whole else []
    return docs.select("doc_id", "source", count_words(text_or_empty()).alias("size"), order_key(seed).alias("key"), *row)


def placed(found: DataFrame, seed: int, schedules, rows_per_range: int) -> DataFrame:
    """The rows of :func:`sized` with their place: ``source_size, target, take_1, take_2, taken, position_1, position_2``."""
    bits = max(0, math.ceil(math.log2(max(1, found.count()) / rows_per_range)))
    named = F.when(F.col("source").isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col("source")))
    keyed = found.withColumns({"range": F.shiftright("key", 4 * DIGITS - bits), "name": named})

    group = ["name", "range"]
    ranges = materialize(keyed.groupBy("source", *group).agg(F.sum("size").alias("range_size")), "mix-ranges")
    wanted = targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size"))).withColumn("name", named).drop("source")
    bases = _running(ranges.withColumn("coarse", F.shiftright("range", bits // 2))).join(wanted, "name")

    order = ("key", "doc_id", "size")
    within = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    begun = keyed.join(bases, group).withColumn("start", F.col("base") + F.sum("size").over(within) - F.col("size"))
    start, size, whole = F.col("start"), F.col("size"), F.col("source_size")
    quota = F.floor("target").cast("long")
    takes = begun.withColumns({"take_1": _overlap(start, size, F.least(quota, whole)), "take_2": _overlap(start, size, quota - whole)})

    def position(take: str, offset: Column) -> Column:
        share = (offset + F.col(take) / 2) / F.col("target")
        by_place = F.lit(None).cast("double")
        for place in range(len(schedules)):
            by_place = F.when(F.col("place") == place, time_of(share, schedules[place])).otherwise(by_place)
        return F.when(F.col(take) > 0, by_place)

    return takes.withColumns({"taken": F.col("take_1") + F.col("take_2"), "position_1": position("take_1", start), "position_2": position("take_2", whole + start)})


ADDED = ("size", "source_size", "target", "taken", "take_1", "take_2", "position_1", "position_2")
REPORTED = ("size", "source_size", "target", "taken", "position_1", "position_2")


def assign(docs: DataFrame, seed: int = 0, schedules=SCHEDULES, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """``docs`` with ``size, source_size, target, taken``, and words and position of either epoch (``take_1`` ...)."""
    found = placed(sized(docs, seed, whole=True), seed, schedules, rows_per_range)
    return found.select(F.struct("row.*").dropFields(*ADDED).alias("row"), *ADDED).select("row.*", *ADDED)


def report(docs: DataFrame, seed: int = 0) -> DataFrame:
    """What the mix takes of every document, and when, in training order: by first position, untaken documents last.

    The text is read once; the rest works on ids and sizes.
    """
    found = placed(materialize(sized(docs, seed), "mix-sizes"), seed, SCHEDULES, ROWS_PER_RANGE)
    order = (F.asc_nulls_last("position_1"), F.asc_nulls_last("position_2"), F.asc("key"))
    return found.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", *REPORTED)


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.split(F.translate(text, SPACES, " " * len(SPACES)), " ")
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("end"))

    def step(acc: Column, piece: Column) -> Column:
        more = F.struct(
            (acc["words"] + (piece != "").cast("long")).alias("words"),
            (acc["end"] + F.length(piece) + 1).alias("end"),
        )
        return F.when(acc["words"] >= n, acc).otherwise(more)

    end = F.aggregate(pieces, start, step, lambda acc: acc["end"])
    return F.substring(text, F.lit(1), F.greatest(end - 1, F.lit(0)))


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """The mix itself in training order: the columns of ``docs``, a row for each epoch of a document.

    ``n_chars``, where there is one, follows the text of a document that the target cuts.
    """
    found = placed(sized(docs, seed, whole=True), seed, SCHEDULES, ROWS_PER_RANGE)
    epochs = F.array(*(F.struct(F.col(f"take_{k}").alias("take"), F.col(f"position_{k}").alias("position")) for k in (1, 2)))
    rows = found.withColumn("epoch", F.explode(F.filter(epochs, lambda e: e["take"] > 0)))
    order = ("epoch.position", "key", "epoch.take")
    dealt = rows.select("row", "epoch", "key", "size").repartitionByRange(*order).sortWithinPartitions(*order)
    take, cut, row = F.col("epoch.take"), F.col("epoch.take") < F.col("size"), F.col("row")
    text = F.when(cut, first_words(row["text"], take)).otherwise(row["text"])
    row = row.withField("text", text)
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.when(cut, F.length(text).cast("long")).otherwise(F.col("row")["n_chars"]))
    return dealt.select(row.alias("row")).select("row.*")
