"""Measured service rate and square-root staffing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.numeric import at_least

INF = float("inf")


def service_rate(rows: DataFrame, by: Sequence[str], max_rel_se: float = 0.08) -> DataFrame:
    """Marginal covers per server-hour of each comparable set.

    ``rows``: (by…, date, covers, server_hours, total_hours). Hours are fitted on
    covers above the floor (tenth percentile plus 12 %); where too few rows lie
    above it, on the upper 60 % by covers. The rate is withheld when its slope is
    not known to the given relative error.
    """
    full = W.partitionBy(*by)
    ranked = (
        rows.withColumn("_n", F.count(F.lit(1)).over(full))
        .withColumn("_floor", F.percentile("server_hours", 0.1).over(full))
        .withColumn("_rank", F.row_number().over(full.orderBy("covers", "date")))
    )
    above = F.col("server_hours") > F.col("_floor") * 1.12
    ranked = ranked.withColumn("_above", F.sum(above.cast("int")).over(full))
    few = F.col("_above") < F.greatest(F.lit(12.0), F.col("_n") * 0.35)
    used = F.when(few, F.col("_rank") - 1 >= F.floor(F.col("_n") * 0.4)).otherwise(above)
    x = F.when(used, F.col("covers").cast("double"))
    y = F.when(used, F.col("server_hours"))
    fitted = ranked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_all"),
        F.count(x).alias("n"),
        F.max("_floor").alias("floor_hours"),
        F.regr_sxx(y, x).alias("_sxx"),
        F.regr_syy(y, x).alias("_syy"),
        F.regr_sxy(y, x).alias("_sxy"),
        F.avg(x).alias("_mx"),
        F.avg(y).alias("_my"),
        (F.sum("total_hours") / F.greatest(F.lit(0.25), F.sum("server_hours"))).alias("roster_ratio"),
    )
    spread = F.col("_sxx") > 1e-9
    slope = F.when(spread, F.try_divide("_sxy", "_sxx")).otherwise(F.lit(0.0))
    rss = at_least(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), 0.0)
    error = F.when(spread, F.sqrt(F.try_divide(rss / at_least(F.col("n") - 2, 1), F.col("_sxx")))).otherwise(F.lit(INF))
    out = fitted.withColumn("slope", slope).withColumn("se_slope", error)
    out = out.withColumn("rel_se", F.when(F.col("slope") > 1e-9, F.try_divide("se_slope", "slope")).otherwise(F.lit(INF)))
    known = (F.col("slope") > 1e-4) & (F.col("rel_se") <= max_rel_se)
    return out.withColumn("mu", F.when(known, F.try_divide(F.lit(1.0), F.col("slope")))).select(
        *by, "n_all", "n", "floor_hours", "slope", "se_slope", "rel_se",
        (F.col("_my") - F.col("slope") * F.col("_mx")).alias("intercept"), "roster_ratio", "mu",
    )


def required_hours(covers: Column, daypart_hours: Column, mu: Column, roster_ratio: Column, z: float = 0.6) -> Column:
    """Paid hours a service needs: load plus z times its square root, at least two servers; null without a rate."""
    load = covers / daypart_hours / mu
    staff = at_least(load + z * F.sqrt(at_least(load, 0.01)), 2.0)
    return F.when(mu.isNotNull(), staff * daypart_hours * roster_ratio)


def required_hours_se(covers: Column, daypart_hours: Column, mu: Column, rel_se: Column, roster_ratio: Column, z: float = 0.6) -> Column:
    """Error of the requirement that comes from the rate (delta method); null without a rate."""
    load = covers / daypart_hours / mu
    slope = (load / mu + (z * 0.5) / F.sqrt(at_least(load, 0.01)) * (load / mu)) * daypart_hours * roster_ratio
    return F.abs(slope) * rel_se * mu


def paid_hours(role_shifts: DataFrame, server_roles: Sequence[str]) -> DataFrame:
    """Server hours, all paid hours and their cost per service."""
    serving = F.col("role").isin(list(server_roles))
    return role_shifts.groupBy("loc", "date", "daypart").agg(
        F.coalesce(F.sum(F.when(serving, F.col("clocked_hours"))), F.lit(0.0)).alias("server_hours"),
        F.sum("clocked_hours").alias("total_hours"),
        F.sum(F.col("clocked_hours") * F.col("rate_cents")).alias("cost_cents"),
    )


def staffed_services(services: DataFrame, role_shifts: DataFrame, server_roles: Sequence[str]) -> DataFrame:
    hours = paid_hours(role_shifts, server_roles)
    out = services.select("loc", "date", "daypart", "dow", "covers").join(hours, ["loc", "date", "daypart"], "left")
    return out.fillna(0.0, ["server_hours", "total_hours", "cost_cents"])


def other_weekdays(rows: DataFrame) -> DataFrame:
    """Each service once per weekday it is a peer of (the judged weekday never sits in its own benchmark)."""
    peers_of = F.filter(F.array(*(F.lit(d) for d in range(7))), lambda d: d != F.col("dow"))
    return rows.withColumn("dow", F.explode(peers_of))
