"""Dated series over services and item-days, scopes and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.dates import week_of
from ..functions.numeric import at_least, mean0, pearson0, sd0, var0
from . import selection

Agg = Literal["mean", "sum"]


def per_cover(amount: Column) -> Column:
    return amount / at_least(F.col("covers"), 1)


# Named per-service measures; a caller may pass any other Column instead.
SERVICE_METRICS = {
    "labour_per_cover": lambda: per_cover(F.col("labor_cents")),
    "comps_per_cover": lambda: per_cover(F.col("comps_cents")),
    "cm_per_cover": lambda: per_cover(F.col("net_cents") - F.col("cogs_cents")),
    "cogs_per_cover": lambda: per_cover(F.col("cogs_cents")),
    "net_per_cover": lambda: per_cover(F.col("net_cents")),
    "ticket_min": lambda: F.col("ticket_min"),
}
GUARDRAIL_METRICS = {
    "net_sales": lambda: F.col("net_cents"),
    "covers": lambda: F.col("covers"),
    "ticket_time": lambda: F.col("ticket_min"),
    "rating": lambda: F.col("rating"),
    "overtime": lambda: F.col("hours"),
    "comps": lambda: F.col("comps_cents") / at_least(F.col("gross_cents"), 1),
    "check_average": lambda: per_cover(F.col("net_cents")),
}


def service_metric(name: str) -> Column:
    return SERVICE_METRICS[name]()


def comps_rate() -> Column:
    return GUARDRAIL_METRICS["comps"]()


def service_scope(
    locs: Sequence[str] | None = None, dayparts: Sequence[str] | None = None, dows: Sequence[int] | None = None
) -> Column:
    """Conjunction of optional membership tests."""
    test = F.lit(True)
    for name, values in (("loc", locs), ("daypart", dayparts), ("dow", dows)):
        if values is not None:
            test = test & F.col(name).isin(list(values))
    return test


def in_location_scope(locs: Sequence[str]) -> Column:
    """The record names one of the locations, or belongs to the group."""
    return F.coalesce(F.arrays_overlap(F.col("locs"), F.array(*(F.lit(x) for x in locs))), F.lit(False)) | (
        F.col("loc") == "group"
    )


def _reduce(y: Column, agg: Agg) -> Column:
    return F.sum(y) if agg == "sum" else F.avg(y)


def service_series(services: DataFrame, scope: Column, metric: Column, agg: Agg = "mean", by: Sequence[str] = ()) -> DataFrame:
    """One point per date (and per ``by`` key) over the services in scope."""
    return services.filter(scope).groupBy(*by, "date").agg(_reduce(metric.cast("double"), agg).alias("y"))


def item_series(
    item_days: DataFrame, loc: str | None, items: Sequence[str] | None, metric: Column, agg: Agg = "sum", by: Sequence[str] = ()
) -> DataFrame:
    rows = item_days
    if loc is not None:
        rows = rows.filter(F.col("loc") == loc)
    if items is not None:
        rows = rows.filter(F.col("item").isin(list(items)))
    return rows.groupBy(*by, "date").agg(_reduce(metric.cast("double"), agg).alias("y"))


def to_weekly(series: DataFrame, agg: Agg = "mean", by: Sequence[str] = ()) -> DataFrame:
    """Monday weeks: mean or sum of the points, so a mean is a mean of daily means."""
    return series.groupBy(*by, week_of("date").alias("date")).agg(_reduce(F.col("y"), agg).alias("y"))


def last_n(series: DataFrame, n: int, by: Sequence[str], order: str = "date") -> DataFrame:
    w = W.partitionBy(*by).orderBy(F.col(order).desc())
    return series.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def describe(series: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    x = F.col(y)
    return series.groupBy(*by).agg(
        F.count(x).alias("n"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("total"),
        mean0(x).alias("mean"),
        var0(x).alias("variance"),
        sd0(x).alias("sd"),
    )


def quantiles(series: DataFrame, by: Sequence[str], levels: dict[str, float], y: str = "y") -> DataFrame:
    """Exact interpolated quantiles of groups of any size (``selection``); 0 for a group without values."""
    return selection.quantiles(series, by, levels, y)


def correlation(pairs: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), pearson0(F.col(x), F.col(y)).alias("r"))


def ols_columns(x: Column, y: Column) -> dict[str, Column]:
    """Slope, intercept and slope error as aggregates; under 3 rows the slope is 0 and its error infinite."""
    n = F.count(F.when(x.isNotNull() & y.isNotNull(), 1))
    sxx, syy, sxy = F.regr_sxx(y, x), F.regr_syy(y, x), F.regr_sxy(y, x)
    flat = sxx <= 1e-12
    slope = F.when((n < 3) | flat, F.lit(0.0)).otherwise(F.try_divide(sxy, sxx))
    rss = F.greatest(syy - F.when(flat, F.lit(0.0)).otherwise(F.try_divide(sxy * sxy, sxx)), F.lit(0.0))
    error = F.when((n < 3) | flat, F.lit(float("inf"))).otherwise(F.sqrt(F.try_divide(rss / F.greatest(n - 2, F.lit(1)), sxx)))
    intercept = F.when(n < 3, F.avg(y)).otherwise(F.avg(y) - slope * F.avg(x))
    return {"n": n, "slope": slope, "intercept": intercept, "se_slope": error}


def ols(rows: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    return rows.groupBy(*by).agg(*(c.alias(k) for k, c in ols_columns(F.col(x), F.col(y)).items()))


def index_slope(series: DataFrame, by: Sequence[str], y: str = "y") -> DataFrame:
    """Slope of a series on its own index."""
    at = F.row_number().over(W.partitionBy(*by).orderBy("date")) - 1
    slope = F.coalesce(F.regr_slope(F.col(y), F.col("_i").cast("double")), F.lit(0.0))
    return series.withColumn("_i", at).groupBy(*by).agg(slope.alias("slope"))


def welch_columns(va: Column, na: Column, vb: Column, nb: Column) -> dict[str, Column]:
    """Standard error and degrees of freedom of a difference of two means."""
    a = va / at_least(na, 1)
    b = vb / at_least(nb, 1)
    den = a * a / at_least(na - 1, 1) + b * b / at_least(nb - 1, 1)
    return {
        "se": F.sqrt(a + b),
        "df": F.when(den > 0, (a + b) * (a + b) / F.when(den > 0, den)).otherwise(at_least(na + nb - 2, 1).cast("double")),
    }


def welch(rows: DataFrame, by: Sequence[str], y: str, is_first: Column) -> DataFrame:
    a, b = F.when(is_first, F.col(y)), F.when(~is_first, F.col(y))
    moments = rows.groupBy(*by).agg(
        F.count(a).alias("n_a"), F.count(b).alias("n_b"), mean0(a).alias("mean_a"), mean0(b).alias("mean_b"),
        var0(a).alias("var_a"), var0(b).alias("var_b"),
    )
    out = welch_columns(F.col("var_a"), F.col("n_a"), F.col("var_b"), F.col("n_b"))
    return moments.select(*by, "n_a", "n_b", "mean_a", "mean_b", out["se"].alias("se"), out["df"].alias("df"))


def control_chart_frame(
    series: DataFrame, by: Sequence[str], baseline_n: int = 28, points: int = 160, y: str = "v", onsets: DataFrame | None = None
) -> DataFrame:
    """The last points of each series with baseline limits, out-of-limit flags and onset marks."""
    recent = last_n(series, points, by)
    full = W.partitionBy(*by)
    seq = full.orderBy("date")
    marked = recent.withColumn("idx", F.row_number().over(seq)).withColumn("_n", F.count(F.lit(1)).over(full))
    base = F.when(F.col("idx") <= F.greatest(F.lit(2), F.least(F.lit(baseline_n), F.col("_n"))), F.col(y))
    mu = F.avg(base).over(full)
    sd = F.coalesce(F.stddev_samp(base).over(full), F.lit(0.0))
    out = marked.withColumn("mu", mu).withColumn("sd", F.when(sd == 0, F.lit(1e-9)).otherwise(sd))
    out = (
        out.withColumn("ucl", F.col("mu") + 3 * F.col("sd"))
        .withColumn("lcl", F.col("mu") - 3 * F.col("sd"))
        .withColumn("outside", (F.col(y) > F.col("ucl")) | (F.col(y) < F.col("lcl")))
        .filter(F.col("_n") >= 3)
        .drop("_n")
    )
    if onsets is None:
        return out
    out = out.join(onsets.select(*by, "onset_date", "signal_date"), list(by), "left")
    first = lambda d: F.min(F.when(F.col("date") >= F.col(d), F.col("date"))).over(W.partitionBy(*by))
    return (
        out.withColumn("is_onset", F.coalesce(F.col("date") == first("onset_date"), F.lit(False)))
        .withColumn("is_signal", F.coalesce(F.col("date") == first("signal_date"), F.lit(False)))
        .drop("onset_date", "signal_date")
    )


def counterfactual_series(pairs: DataFrame, key: str = "intervention_id", points: int = 40) -> DataFrame:
    """Treated points next to the control moved by the gap of the pre-period means.

    ``pairs`` holds (key, date, exec_on, t, c).
    """
    treated = last_n(pairs.filter(F.col("t").isNotNull()), points, [key])
    full = W.partitionBy(key)
    pre = F.col("date") < F.col("exec_on")
    pre_t = F.avg(F.when(pre, F.col("t"))).over(full)
    pre_c = F.avg(F.when(pre, F.col("c"))).over(full)
    shift = F.coalesce(pre_t - pre_c, F.lit(0.0))
    return (
        treated.withColumn("_n", F.count(F.lit(1)).over(full))
        .withColumn("counterfactual", F.col("c") + shift)
        .filter(F.col("_n") >= 4)
        .drop("_n")
    )
