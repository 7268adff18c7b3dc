"""Exact order statistics of groups of any size, without sorting them or holding them in one buffer.

A wanted rank is closed in on: each round counts a group's values in ``BINS`` equal steps between the least and the
greatest value still possible, and keeps the step that holds the rank, with the least and greatest value found in it.
Both ends are steps of their own, so every round gains; a step of one value is the answer. A task holds one row per
group, open range and step; values themselves are never collected, and the rows are not moved.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import durable

BINS = 1024
LARGEST, SMALLEST = 1.7976931348623157e308, 5e-324
#: Groups of at most so many rows are ordered directly: by a buffer of their own or a sort in one task.
DIRECT_ROWS = 100_000


def same(left: str, right: str, by: Sequence[str]) -> Column:
    """Equality of keys in which nulls match."""
    return reduce(lambda a, b: a & b, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in by), F.lit(True))


def _finite(x: Column) -> Column:
    return F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), x))


def _magnitude(x: Column) -> Column:
    """Grows with x, by equal amounts from one power of ten to the next."""
    return F.signum(x) * (F.ln(F.greatest(F.abs(x), F.lit(SMALLEST))) + 750)


def _step(value: Column, lo: Column, hi: Column, by_magnitude: bool) -> Column:
    """The step of a value between the ends, which have steps of their own; any map that never falls would do."""
    v, a, b = (_finite(x) for x in (value, lo, hi))
    if by_magnitude:
        v, a, b = (_magnitude(x) for x in (v, a, b))
    share = F.coalesce(F.try_divide(v / 2 - a / 2, b / 2 - a / 2), F.lit(0.5))
    inner = 1 + F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)) * (BINS - 3)).cast("int")
    return F.when(value <= lo, 0).when(value >= hi, BINS - 1).otherwise(inner)


def values_at(rows: DataFrame, by: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """(keys, rank, value): the value at each wanted 0-based rank of its group in ascending order; nulls have no rank.

    ``wanted``: (keys, rank). Rounds take equal steps of value and of magnitude in turn, so that a few end any search.
    """
    v = F.col(value).cast("double")
    facts = rows.select(*by, v.alias("_v")).filter(F.col("_v").isNotNull())
    asked = wanted.select(*by, "rank").distinct()
    groups = asked.select(*by).distinct()
    span = facts.alias("a").join(groups.alias("b"), same("a", "b", by), "left_semi").groupBy(*by).agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.count(F.lit(1)).alias("n"))
    state = asked.alias("a").join(span.alias("b"), same("a", "b", by)).select(*(F.col(f"a.{c}").alias(c) for c in by), "rank", "lo", "hi", "n", F.lit(0).cast("bigint").alias("before"))
    state = durable(state.filter((F.col("rank") >= 0) & (F.col("rank") < F.col("n"))).drop("n"))
    turn = 0
    while state.filter("lo < hi").limit(1).count():
        open_ = state.filter("lo < hi").select(*by, "lo", "hi").distinct()
        met = facts.alias("a").join(open_.alias("b"), same("a", "b", by) & (F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        met = met.select(*(F.col(f"a.{c}").alias(c) for c in by), "lo", "hi", "_v").withColumn("_step", _step(F.col("_v"), F.col("lo"), F.col("hi"), by_magnitude=turn % 2 == 1))
        steps = met.groupBy(*by, "lo", "hi", "_step").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        earlier = W.partitionBy(*by, "lo", "hi").orderBy("_step").rowsBetween(W.unboundedPreceding, -1)
        steps = steps.withColumn("_below", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        in_range = same("a", "b", by) & (F.col("a.lo") == F.col("b.lo")) & (F.col("a.hi") == F.col("b.hi"))
        place = F.col("rank") - F.col("before")
        hit = state.alias("a").join(steps.alias("b"), in_range).filter((place >= F.col("_below")) & (place < F.col("_below") + F.col("_n")))
        closer = hit.select(*(F.col(f"a.{c}").alias(c) for c in by), "rank", F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), (F.col("before") + F.col("_below")).alias("before"))
        turn += 1
        state = durable(state.filter("lo >= hi").select(*by, "rank", "lo", "hi", "before").unionByName(closer))
    return state.select(*by, "rank", F.col("lo").alias("value"))


def quantiles(rows: DataFrame, by: Sequence[str], levels: dict[str, float], value: str, direct_rows: int = DIRECT_ROWS) -> DataFrame:
    """Quantiles interpolated on (n - 1) * level, 0 for a group without values."""
    x = F.col(value)
    at = lambda q: F.coalesce(F.percentile(x, q), F.lit(0.0))
    sizes = durable(rows.groupBy(*by).agg(F.count(x).alias("n")))
    large = sizes.filter(F.col("n") > direct_rows)
    if not large.limit(1).count():
        return rows.groupBy(*by).agg(*(at(q).alias(name) for name, q in levels.items()))
    small = rows.alias("a").join(large.select(*by).alias("b"), same("a", "b", by), "left_anti").groupBy(*by).agg(*(at(q).alias(name) for name, q in levels.items()))
    asks = F.array(*(F.struct(F.lit(name).alias("name"), ((F.col("n") - 1) * F.lit(q)).alias("at")) for name, q in levels.items()))
    asked = large.select(*by, F.inline(asks)).withColumn("low", F.floor("at")).withColumn("high", F.ceil("at"))
    wanted = asked.select(*by, F.explode(F.array("low", "high")).alias("rank"))
    found = values_at(rows, by, value, wanted)
    ranked = asked.select(*by, "name", "at", "low", "high", F.explode(F.array("low", "high")).alias("rank"))
    met = ranked.alias("a").join(found.alias("b"), same("a", "b", by) & (F.col("a.rank") == F.col("b.rank"))).select(*(F.col(f"a.{c}").alias(c) for c in by), "name", "at", "low", "high", F.col("a.rank").alias("rank"), "value")
    lower, upper = (F.max(F.when(F.col("rank") == F.col(side), F.col("value"))) for side in ("low", "high"))
    share = F.max(F.col("at") - F.col("low"))
    mixed = met.groupBy(*by, "name").agg((lower * (1 - share) + upper * share).alias("q"))
    big = mixed.groupBy(*by).agg(*(F.max(F.when(F.col("name") == name, F.col("q"))).alias(name) for name in levels))
    return small.unionByName(big)
