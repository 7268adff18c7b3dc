"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time 0 to 1: knots joined by straight lines. The area under it is
the source's weight; its shape says when the source's words are wanted. Targets share the budget by weight, stop at
``max_repeats`` times the source, and hand their excess to the others. A source's documents stand in a seeded shuffle;
a document's words begin where the words before it end, and the cumulative demand of the source, inverted there, is
its training position. The last document of a target is taken in part, so targets are met to the word.

Nulls: a null text has no words; a null source is a source of its own, last in order. Documents without words take
nothing. Rows with a null doc_id are shuffled by all that they hold. Repeated rows are separate documents. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable, number_rows
from .common import before_slice, in_slice, join_sized, let, slice_totals, sliced, word_count, without

SEED = "mix-1"
#: Fixed values of the production mix: weights of the sources in order, repeating, and how each one moves in time.
KNOTS = (((0.0, 7.5), (1.0, 2.5)), ((0.0, 2.0), (1.0, 2.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 2.0)))
SHARE = 1.5
MAX_REPEATS = 2


def repeating_schedule(schedules=KNOTS) -> Callable[[Column], Column]:
    """Schedules dealt to the sources in order, repeating; ``rank`` counts from 1."""
    kinds = F.array(*(F.array(*(F.struct(F.lit(float(t)).alias("at"), F.lit(float(w)).alias("weight")) for t, w in knots)) for knots in schedules))
    return lambda rank: F.element_at(kinds, (F.pmod(rank - 1, F.lit(len(schedules))) + 1).cast("int"))


def _pieces(knots: Column) -> Column:
    """Straight pieces of a schedule, each with the area before it."""
    first = F.struct(F.lit(0.0).alias("area"), F.expr("cast(array() as array<struct<from: double, till: double, low: double, slope: double, before: double>>)").alias("out"))

    def add(state, i):
        a, b = F.get(knots, i - 1), F.get(knots, i)
        piece = F.struct(
            a["at"].alias("from"), b["at"].alias("till"), a["weight"].alias("low"), ((b["weight"] - a["weight"]) / (b["at"] - a["at"])).alias("slope"), state["area"].alias("before")
        )
        return F.struct((state["area"] + (a["weight"] + b["weight"]) / 2 * (b["at"] - a["at"])).alias("area"), F.concat(state["out"], F.array(piece)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), F.size(knots) - 1), first, add)


def targets(sources: DataFrame, schedule: Callable[[Column], Column], share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds weight and target to durable rows of ``_g, _name, source_size``.

    The level is the words per weight of every source below its cap. Each round fixes the sources above their cap and
    raises the level of the rest, until none is above: sums over the source table, of which one row comes back.
    """
    ranked = number_rows(sources, [F.col("_name").asc_nulls_last()], "rank")
    curves = durable(
        ranked.withColumn("_curve", _pieces(schedule(F.col("rank")))).select("*", F.col("_curve.area").alias("weight"), F.col("_curve.out").alias("pieces"), (max_repeats * F.col("source_size")).alias("_cap")).drop("_curve")
    )
    total, weight = curves.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (total or 0), 0.0
    following = budget / weight if weight else 0.0
    while following > level:
        level = following
        above = F.col("_cap") <= F.lit(level) * F.col("weight")
        fixed, free = curves.agg(F.sum(F.when(above, F.col("_cap"))), F.sum(F.when(~above, F.col("weight")))).first()
        following = (budget - (fixed or 0)) / free if free else level
    return curves.withColumn("target", F.least(F.col("_cap").cast("double"), F.lit(level) * F.col("weight"))).drop("_cap")


def training_position(pieces: Column, weight: Column, share: Column) -> Column:
    """The time at which a source has served ``share`` (0 to 1) of its demand: the inverse of the schedule's area."""

    def inside(area):
        def solve(p):
            y = area - p["before"]
            root = F.sqrt(F.greatest(F.lit(0.0), p["low"] * p["low"] + 2 * p["slope"] * y))
            below = p["low"] + root
            return F.least(p["till"], p["from"] + F.when(below > 0, 2 * y / below).otherwise(0.0))

        return let(F.element_at(F.filter(pieces, lambda p, i: (i == 0) | (p["before"] <= area)), -1), solve)

    return let(share * weight, inside)


def mix(docs: DataFrame, schedule: Callable[[Column], Column] | None = None, share: float = SHARE, max_repeats: int = MAX_REPEATS, seed: str = SEED) -> DataFrame:
    """Adds size, source_size, target, taken and ``takes``: for each copy taken its number, words and training position.

    One shuffle of the rows, by source and hash slice, serves the running sum; the sizes before a slice come from at
    most 4096 sums per source.
    """
    docs = without(docs, "size", "source_size", "target", "takes", "taken", "weight", "pieces", "rank")
    rows = sliced(docs.withColumn("size", F.coalesce(word_count(F.col("text")), F.lit(0).cast("long"))), "source", ["doc_id"], seed)
    totals = slice_totals(rows, "source", size=F.col("size"))
    sources = durable(totals.groupBy("_g").agg(F.first("_name").alias("_name"), F.sum("size").alias("source_size")))
    plan = targets(sources, schedule or repeating_schedule(), share, max_repeats).select("_g", "source_size", "target", "weight", "pieces")
    slices = join_sized(totals.select("_g", "_slice", before_slice(totals, "size").alias("_before")), durable(plan), ["_g"])
    w = in_slice(["doc_id", "size", F.xxhash64("text")])
    placed = rows.withColumn("_begin", F.sum("size").over(w.rowsBetween(W.unboundedPreceding, -1))).join(slices, ["_g", "_slice"])
    begin = F.col("_before") + F.coalesce(F.col("_begin"), F.lit(0))

    def copy(k):
        at = begin + k * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.round("target").cast("long") - at))
        part = F.least(F.lit(1.0), at / F.greatest(F.col("target"), F.lit(1e-300)))
        return F.struct(k.cast("int").alias("copy"), words.alias("words"), training_position(F.col("pieces"), F.col("weight"), part).alias("position"))

    copies = F.filter(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(max_repeats - 1).cast("long")), copy), lambda c: c["words"] > 0)
    taken = F.aggregate(F.col("takes"), F.lit(0).cast("long"), lambda a, c: a + c["words"])
    return placed.withColumn("takes", copies).withColumn("taken", taken).drop("_g", "_h", "_slice", "_begin", "_before", "weight", "pieces")


def training_order(mixed: DataFrame, most_words: bool = False) -> DataFrame:
    """One row per copy taken, range-sorted by training position.

    With ``most_words``, copies stay whole: one cut by its target counts if most of its words are taken.
    """
    copies = mixed.withColumn("_take", F.explode("takes"))
    if most_words:
        copies = copies.where(2 * F.col("_take.words") >= F.col("size"))
    return copies.select("*", F.col("_take.copy").alias("copy"), F.col("_take.words").alias("words"), F.col("_take.position").alias("position")).drop("_take").orderBy("position", "source", "doc_id", "copy")
