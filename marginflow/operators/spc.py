"""Control charts and change points as window plans.

A series is one row per (key, date), so a window partition is never longer than
the calendar. All windows of one operator share one exchange and one sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


#: Points that a block of the weighted mean folds.
EWMA_BLOCK = 128


class _Frames:
    def __init__(self, by: Sequence[str]):
        self.full = W.partitionBy(*by)
        self.seq = self.full.orderBy("date")
        self.running = self.seq.rowsBetween(W.unboundedPreceding, W.currentRow)


def baseline_moments(series: DataFrame, by: Sequence[str], baseline_n: int | Column = 28, v: str = "v") -> DataFrame:
    """Adds the 1-based index ``i``, the length ``n`` and mean and sd of the first points.

    The baseline is the first max(2, min(baseline_n, length)) points; a spread of 0 becomes 1e-9.
    """
    f = _Frames(by)
    want = baseline_n if isinstance(baseline_n, Column) else F.lit(baseline_n)
    indexed = series.withColumn("i", F.row_number().over(f.seq)).withColumn("n", F.count(F.lit(1)).over(f.full))
    base = F.when(F.col("i") <= F.greatest(F.lit(2), F.least(want, F.col("n"))), F.col(v))
    sd = F.coalesce(F.stddev_samp(base).over(f.full), F.lit(0.0))
    return indexed.withColumn("mu", F.avg(base).over(f.full)).withColumn("sd", F.when(sd == 0, F.lit(1e-9)).otherwise(sd))


def ewma_chart(
    series: DataFrame, by: Sequence[str], lam: float = 0.25, limit: float = 3.0, baseline_n: int | Column = 28, v: str = "v"
) -> DataFrame:
    """Exponentially weighted mean with its time-varying limits and signals.

    The recursion z = lam * x + (1 - lam) * z is an affine map of z, and so is a block
    of points. Each row folds the points of its own block and, over the ends of the
    blocks before, the maps of whole blocks from the baseline mean on. All points stay
    in the sum, whatever the weight.
    """
    keep = 1 - lam
    f = _Frames(by)
    based = baseline_moments(series, by, baseline_n, v).withColumn("_k", F.pmod(F.col("i") - 1, F.lit(EWMA_BLOCK)).cast("int") + 1)
    recent = F.collect_list(F.col(v).cast("double")).over(f.seq.rowsBetween(-(EWMA_BLOCK - 1), W.currentRow))
    own = F.aggregate(F.slice("_x", -F.col("_k"), F.col("_k")), F.lit(0.0), lambda acc, x: F.lit(lam) * x + F.lit(keep) * acc)
    folded = based.withColumn("_x", recent).withColumn("_own", own)
    ended = F.collect_list(F.when(F.col("_k") == EWMA_BLOCK, F.col("_own"))).over(f.seq.rowsBetween(W.unboundedPreceding, -1))
    start = F.aggregate("_ended", F.col("mu"), lambda acc, end: end + F.lit(float(keep**EWMA_BLOCK)) * acc)
    windowed = folded.withColumn("_ended", ended)
    z = F.col("_own") + F.pow(F.lit(float(keep)), F.col("_k")) * start
    width = F.lit(limit) * F.col("sd") * F.sqrt(F.lit(lam / (2 - lam)) * (1 - F.pow(F.lit(1 - lam), 2 * F.col("i"))))
    out = windowed.withColumn("z", z).withColumn("ucl", F.col("mu") + width).withColumn("lcl", F.col("mu") - width)
    return out.withColumn(
        "signal", F.when(F.col("z") > F.col("ucl"), "high").when(F.col("z") < F.col("lcl"), "low")
    ).drop("_x", "_k", "_own", "_ended")


def cusum_chart(
    series: DataFrame, by: Sequence[str], k: float = 0.5, h: float = 4.0, baseline_n: int | Column = 28, v: str = "v"
) -> DataFrame:
    """Two one-sided accumulators.

    ``max(0, S + x - k)`` equals the running sum of (x - k) minus its own running
    minimum (at most 0), so two window passes replace the recursion, and the sum
    is exactly 0 where it meets its minimum.
    """
    f = _Frames(by)
    x = (F.col(v) - F.col("mu")) / F.col("sd")
    out = baseline_moments(series, by, baseline_n, v)
    out = out.withColumn("_up", F.sum(x - k).over(f.running)).withColumn("_down", F.sum(-x - k).over(f.running))
    low = lambda c: F.least(F.lit(0.0), F.min(c).over(f.running))
    out = out.withColumn("s_hi", F.col("_up") - low("_up")).withColumn("s_lo", F.col("_down") - low("_down"))
    return out.withColumn("signal", F.when(F.col("s_hi") > h, "high").when(F.col("s_lo") > h, "low")).drop("_up", "_down")


def _split_score(pre: Column, total: Column, t: Column, n: Column, direction: Column) -> Column:
    """Size of the mean shift at split t, null where t is not a legal split."""
    diff = F.try_divide(total - pre, n - t) - F.try_divide(pre, t)
    legal = (n >= 6) & (t >= 3) & (t <= n - 3)
    wrong = ((direction == "high") & (diff <= 0)) | ((direction == "low") & (diff >= 0))
    return F.when(legal & ~F.coalesce(wrong, F.lit(False)), F.abs(diff) * F.sqrt(F.try_divide(t * (n - t), n)))


def change_point(series: DataFrame, by: Sequence[str], direction: str | None = None, v: str = "v") -> DataFrame:
    """The split with the largest mean shift; the first of equal ones. ``split`` counts the points on its left."""
    f = _Frames(by)
    ways = F.lit(direction).cast("string")
    out = series.withColumn("t", F.row_number().over(f.seq)).withColumn("n", F.count(F.lit(1)).over(f.full))
    out = out.withColumn("_pre", F.sum(v).over(f.running)).withColumn("_all", F.sum(v).over(f.full))
    out = out.withColumn("_score", _split_score(F.col("_pre"), F.col("_all"), F.col("t"), F.col("n"), ways))
    out = out.withColumn("_best", F.max("_score").over(f.full))
    return out.groupBy(*by).agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("_score") == F.col("_best"), F.col("t"))).alias("split"),
        F.max("_best").alias("score"),
    )


def drift_onset(cusum: DataFrame, by: Sequence[str], direction: str | None = None, lookback: int = 120, v: str = "v") -> DataFrame:
    """First signal of each series and the day its drift began; series without a signal are left out.

    The start is the point after the accumulator's last zero before the signal,
    moved to the change point of the run-up where that falls between the two.
    """
    f = _Frames(by)
    hit = F.col("signal").isNotNull() if direction is None else F.col("signal") == direction
    out = cusum.withColumn("_sig", F.min(F.when(hit, F.col("i"))).over(f.full)).filter(F.col("_sig").isNotNull())
    out = out.withColumn("_dir", F.max(F.when(F.col("i") == F.col("_sig"), F.col("signal"))).over(f.full))
    s = F.when(F.col("_dir") == "high", F.col("s_hi")).otherwise(F.col("s_lo"))
    rest = F.max(F.when((s == 0) & (F.col("i") < F.col("_sig")), F.col("i"))).over(f.full)
    out = out.withColumn("_walk", F.coalesce(rest, F.lit(0)) + 1)
    out = out.withColumn("_lo", F.greatest(F.lit(1), F.col("_sig") - lookback)).withColumn(
        "_hi", F.least(F.col("n"), F.col("_sig") + 6)
    )
    inside = (F.col("i") >= F.col("_lo")) & (F.col("i") <= F.col("_hi"))
    part = F.when(inside, F.col(v)).otherwise(F.lit(0.0))
    out = out.withColumn("_pre", F.sum(part).over(f.running)).withColumn("_all", F.sum(part).over(f.full))
    t = F.col("i") - F.col("_lo") + 1
    score = _split_score(F.col("_pre"), F.col("_all"), t, F.col("_hi") - F.col("_lo") + 1, F.col("_dir"))
    out = out.withColumn("_score", F.when(inside, score))
    out = out.withColumn("_best", F.max("_score").over(f.full))
    out = out.withColumn("_cp", F.min(F.when(F.col("_score") == F.col("_best"), F.col("i") + 1)).over(f.full))
    usable = (F.col("_cp") >= F.col("_walk")) & (F.col("_cp") <= F.col("_sig"))
    out = out.withColumn("_on", F.when(usable, F.col("_cp")).otherwise(F.col("_walk")))
    return out.groupBy(*by).agg(
        F.max("_on").cast("int").alias("onset_index"),
        F.max(F.when(F.col("i") == F.col("_on"), F.col("date"))).alias("onset_date"),
        F.max("_sig").cast("int").alias("signal_index"),
        F.max(F.when(F.col("i") == F.col("_sig"), F.col("date"))).alias("signal_date"),
        F.max("_dir").alias("direction"),
    )
