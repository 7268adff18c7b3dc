"""Treated and control series of many interventions at once, and their estimates.

A comparison with "every other room" is the group's total less the room's own
rows, so it costs the same with ten rooms as with a hundred thousand.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import day, to_date, week_of
from ..functions.numeric import at_least, mean0, normal_quantile_value, pearson0, student_t_quantile, var0
from ..session import attach, durable
from . import costing, prefix
from .series import GUARDRAIL_METRICS, SERVICE_METRICS, welch_columns

Day = str | dt.date
KEY = "intervention_id"


#: What makes two plans watch the same rooms; such plans share one series.
SCOPE = ("treat_locs", "treat_dayparts", "treat_dows", "control_locs", "control_dayparts", "control_dows", "control_others")
METRICS = {**SERVICE_METRICS, **{f"g_{k}": v for k, v in GUARDRAIL_METRICS.items()}}
CELLS = {"pre": ("lo", "start"), "post": ("start", "hi"), "p1": ("lo", "mid"), "p2": ("mid", "start")}


@dataclass
class ScopeDays:
    """The plans with their ``scope``, and one row per distinct scope and date."""

    plans: DataFrame
    days: DataFrame


@dataclass
class Series:
    """Series that plans share: ``plans`` (intervention_id, series, lo, hi) and the dated pairs of each ``series`` (t, c).

    A plan shows its series in the weeks from ``lo`` to ``hi``, which hold all its windows.
    """

    plans: DataFrame
    points: DataFrame

    def pairs(self) -> DataFrame:
        """Treated and control value per intervention and date."""
        return costing.shown(self.plans.select(KEY, "series"), self.points, self.plans.select(KEY, "lo", "hi")).select(KEY, "date", "t", "c")

    def by_date(self, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
        """One set of pairs, with its ``exec_on``, for all plans of a series, span and execution date; and (intervention_id, series) of its members."""
        view = ["series", "lo", "hi", "exec_on", "_copies"]
        asks = self.plans.join(plans.groupBy(KEY, "exec_on").agg(F.count(F.lit(1)).alias("_copies")), KEY)
        member = asks.select(KEY, costing.series_of(*view).alias("_view"), *view)
        views = member.select(F.col("_view").alias(KEY), *view).distinct()
        # A plan declared twice shows its points twice.
        dated = views.select(KEY, "exec_on", F.explode(F.sequence(F.lit(1).cast("bigint"), "_copies"))).drop("col")
        pairs = Series(views.drop("exec_on", "_copies"), self.points).pairs().join(dated, KEY)
        return pairs, member.select(KEY, F.col("_view").alias("series"))


def _weeks(lo: Column, hi: Column) -> Column:
    """Mondays of the weeks a range touches."""
    return F.explode(F.sequence(week_of(lo), week_of(hi), F.expr("interval 7 days")))


def _from() -> Column:
    return F.date_sub("exec_on", F.col("baseline_days"))


def _until(as_of: Day) -> Column:
    return F.greatest(F.date_add("exec_on", F.col("window_days")), day(to_date(as_of)))


def _arms() -> Column:
    """Treated rooms, control rooms, and the rooms taken out of an all-rooms control."""
    arm = lambda name, sign, locs, dayparts, dows: F.struct(
        F.lit(name).alias("arm"), F.lit(sign).alias("sign"), locs.alias("locs"), F.col(dayparts).alias("dayparts"), F.col(dows).alias("dows")
    )
    others = F.coalesce(F.col("control_others"), F.lit(False))
    group = F.when(others, F.array(F.lit("*")))
    return F.array(
        arm("t", 1, F.col("treat_locs"), "treat_dayparts", "treat_dows"),
        arm("c", 1, F.coalesce(group, F.col("control_locs")), "control_dayparts", "control_dows"),
        arm("c", -1, F.when(others, F.col("treat_locs")), "control_dayparts", "control_dows"),
    )


def with_scope(plans: DataFrame) -> DataFrame:
    """Adds ``scope``, a digest of the rooms, dayparts and weekdays of both arms, whatever the order they are named in."""
    parts = [F.array_sort(c).alias(c) if c.endswith("s") and not c.endswith("others") else F.coalesce(c, F.lit(False)).alias(c) for c in SCOPE]
    return plans.withColumn("scope", F.md5(F.to_json(F.struct(*parts))))


def scope_days(plans: DataFrame, services: DataFrame, as_of: Day) -> ScopeDays:
    """Per distinct scope and date: treated and control mean of every service and guardrail metric.

    Columns ``t_<metric>`` and ``c_<metric>``, plus treated ``covers`` and ``services``.
    The dictionary of scopes, not the plans, meets the services, on (room, daypart, week); the
    group stands as a room ``*`` of its own, so all-rooms controls never touch single rooms.
    """
    # The plans are read by every look-up.
    named = durable(with_scope(plans))
    facts = services.select(
        "loc", "date", F.coalesce("daypart", F.lit("")).alias("daypart"), "dow", "covers", F.lit(1).cast("bigint").alias("n"), *(build().cast("double").alias(m) for m, build in METRICS.items())
    )
    group = facts.groupBy(F.lit("*").alias("loc"), "date", "daypart", "dow").agg(*(F.sum(c).alias(c) for c in ("covers", "n", *METRICS)))
    rows = facts.unionByName(group).withColumn("week", week_of("date"))
    spans = named.groupBy("scope").agg(F.min(_from()).alias("_lo"), F.max(_until(as_of)).alias("_hi"), *(F.first(c).alias(c) for c in SCOPE))
    # Dayparts are a dimension of a handful of names.
    dayparts = facts.agg(F.collect_set("daypart").alias("_dayparts"))
    reach = attach(spans.select("scope", "_lo", "_hi", F.inline(_arms())).filter(F.col("locs").isNotNull()), dayparts)
    reach = reach.withColumn("daypart", F.explode(F.coalesce("dayparts", "_dayparts"))).withColumn("week", _weeks(F.col("_lo"), F.col("_hi")))
    reach = reach.select("scope", "arm", "sign", F.explode("locs").alias("loc"), "daypart", "week", "dows")
    met = reach.join(rows, ["loc", "daypart", "week"]).filter(F.col("dows").isNull() | F.array_contains("dows", F.col("dow")))
    part = lambda arm, c: F.sum(F.when(F.col("arm") == arm, F.col("sign") * F.col(c)))
    sums = [part(a, c).alias(f"{a}_{c}") for a in ("t", "c") for c in ("n", *METRICS)]
    daily = met.groupBy("scope", "date").agg(part("t", "covers").alias("covers"), *sums)
    mean = lambda a, c: F.when(F.col(f"{a}_n") > 0, F.try_divide(f"{a}_{c}", f"{a}_n")).alias(f"{a}_{c}")
    days = daily.select(
        "scope", "date", F.coalesce("covers", F.lit(0)).alias("covers"), F.coalesce("t_n", F.lit(0)).alias("services"),
        *(mean(a, c) for a in ("t", "c") for c in METRICS),
    )
    return ScopeDays(named, durable(days))


def _wide(arms: DataFrame) -> DataFrame:
    side = lambda a: F.max(F.when(F.col("arm") == a, F.col("y")))
    return arms.groupBy(KEY, "date").agg(side("t").alias("t"), side("c").alias("c"))


def apply_weekly(pairs: DataFrame, keys: Sequence[str] = (KEY,)) -> DataFrame:
    """Weeks for the plans that chose them (column ``weekly``): a mean of daily means."""
    date = F.when(F.col("weekly"), week_of("date")).otherwise(F.col("date"))
    return pairs.groupBy(*keys, date.alias("date")).agg(F.avg("t").alias("t"), F.avg("c").alias("c"))


def sku_price_arms(plans: DataFrame) -> DataFrame:
    sku = plans.filter(F.col("metric") == "sku_unit_price")
    arms = F.array(
        F.struct(F.lit("t").alias("arm"), F.array("treat_sku").alias("skus")), F.struct(F.lit("c").alias("arm"), F.col("control_skus").alias("skus"))
    )
    return sku.select(KEY, "exec_on", F.inline(arms))


def sku_usage_arms(plans: DataFrame) -> DataFrame:
    rows = plans.filter(F.col("metric") == "sku_cost_per_plate")
    return rows.select(KEY, "exec_on", F.col("treat_sku").alias("sku"), F.inline(_arms())).select(KEY, "exec_on", "sku", "arm", "sign", "locs").filter(F.col("locs").isNotNull())


def item_arms(plans: DataFrame) -> DataFrame:
    """Items of a cost change; without a control the treated items stand for both arms."""
    rows = plans.filter(F.col("metric") == "item_cost_per_unit")
    loc, items = F.col("treat_locs")[0], F.col("treat_items")
    control_loc, control = F.coalesce(F.col("control_locs")[0], loc), F.coalesce(F.col("control_items"), items)
    arms = F.array(
        F.struct(F.lit("t").alias("arm"), loc.alias("loc"), items.alias("items")),
        F.struct(F.lit("c").alias("arm"), control_loc.alias("loc"), control.alias("items")),
    )
    return rows.select(KEY, "grain", F.inline(arms)).select(KEY, "grain", "arm", "loc", F.explode("items").alias("item"))


def item_cost_pairs(plans: DataFrame, item_days: DataFrame, spans: DataFrame) -> DataFrame:
    """Recipe cost of the items per unit sold, or in total, by date, in the weeks of ``spans``."""
    daily = item_days.groupBy("loc", "item", "date").agg(F.sum("units").alias("units"), F.sum(F.col("units") * F.col("cost_cents")).alias("cost"))
    reach = costing.in_weeks(item_arms(plans), spans)
    met = reach.join(daily.withColumn("week", week_of("date")), ["loc", "item", "week"]).groupBy(KEY, "grain", "arm", "date").agg(F.sum("cost").alias("cost"), F.sum("units").alias("units"))
    y = F.when(F.col("grain") == "unit", F.col("cost") / at_least(F.col("units"), 1)).otherwise(F.col("cost").cast("double"))
    return _wide(met.withColumn("y", y))


def series_spans(plans: DataFrame, invoices: DataFrame, item_days: DataFrame, as_of: Day, whole: bool) -> DataFrame:
    """(plan, lo, hi) of the weeks whose purchases and sales a series shows: its windows, or with ``whole`` all that there are."""
    if not whole:
        return plans.select(KEY, _from().alias("lo"), _until(as_of).alias("hi"))
    dated = invoices.select(F.col("week").alias("date")).unionByName(item_days.select("date"))
    return attach(plans.select(KEY), dated.agg(F.min("date").alias("lo"), F.max("date").alias("hi"))).filter(F.col("lo").isNotNull())


def bought_pairs(plans: DataFrame, invoices: DataFrame, item_days: DataFrame, menu: DataFrame, spans: DataFrame) -> DataFrame:
    """Series of plans that are not about services: prices, usage and item costs."""
    price = _wide(costing.indexed_price_series(sku_price_arms(plans), invoices, spans).select(KEY, "arm", "date", "y"))
    usage = _wide(costing.frozen_price_usage(sku_usage_arms(plans), invoices, item_days, menu, spans))
    return price.unionByName(usage).unionByName(item_cost_pairs(plans, item_days, spans))


#: What a series of prices, usage or item costs depends on.
_BOUGHT = ("metric", "grain", "exec_on", "treat_sku", "control_skus", "treat_locs", "control_locs", "control_others", "treat_items", "control_items")


def bought_series(plans: DataFrame, invoices: DataFrame, item_days: DataFrame, menu: DataFrame, spans: DataFrame) -> Series:
    """The series of ``bought_pairs``, one for all plans that ask for the same; each covers the spans of all its plans."""
    rows = plans.filter(~F.col("metric").isin(list(SERVICE_METRICS)))
    daily = F.coalesce("weekly", F.lit(False))
    named = rows.withColumn("_made", costing.series_of(*_BOUGHT)).withColumn("weekly", daily)
    reach = named.join(spans.groupBy(KEY).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")), KEY)
    # The distinct wishes are read by each kind of series, several times.
    made = reach.groupBy(F.col("_made").alias(KEY)).agg(*(F.first(c).alias(c) for c in (*_BOUGHT, "treat_dayparts", "control_dayparts", "treat_dows", "control_dows")), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    made = durable(made)
    pairs = bought_pairs(made.drop("lo", "hi"), invoices, item_days, menu, made.select(KEY, "lo", "hi")).withColumnRenamed(KEY, "_made")
    asks = reach.withColumn("series", costing.series_of("_made", "weekly"))
    return Series(asks.select(KEY, "series", "lo", "hi").distinct(), _stepped(pairs, asks.select("_made", "series", "weekly").distinct(), ["_made"]))


def service_series(scoped: ScopeDays, as_of: Day) -> Series:
    """Every plan's own service metric over its scope, one series for all plans that watch the same."""
    about = scoped.plans.filter(F.col("metric").isin(list(SERVICE_METRICS))).withColumn("weekly", F.coalesce("weekly", F.lit(False)))
    asks = about.filter(F.col(KEY).isNotNull()).select(KEY, "scope", "metric", "weekly", costing.series_of("scope", "metric", "weekly"), _from().alias("lo"), _until(as_of).alias("hi"))
    cells = F.array(*(F.struct(F.lit(m).alias("metric"), F.col(f"t_{m}").alias("t"), F.col(f"c_{m}").alias("c")) for m in SERVICE_METRICS))
    days = scoped.days.select("scope", "date", F.inline(cells))
    return Series(asks.select(KEY, "series", "lo", "hi").distinct(), _stepped(days, asks.select("scope", "metric", "weekly", "series").distinct(), ["scope", "metric"]))


def _stepped(pairs: DataFrame, series: DataFrame, on: Sequence[str]) -> DataFrame:
    """Points of the named series, by day or week as they chose."""
    known = pairs.filter(F.col("t").isNotNull() | F.col("c").isNotNull())
    return apply_weekly(known.join(series, list(on)), ("series",))


def build_series(scoped: ScopeDays, invoices: DataFrame, item_days: DataFrame, menu: DataFrame, as_of: Day, whole: bool = True) -> Series:
    """Treated (``t``) and control (``c``) value per intervention and date, at the plan's grain; plans that watch the same share them.

    Service series cover the weeks of a plan's windows; with ``whole`` the other series cover all weeks on record.
    """
    spans = series_spans(scoped.plans, invoices, item_days, as_of, whole)
    service, bought = service_series(scoped, as_of), bought_series(scoped.plans, invoices, item_days, menu, spans)
    # A series is as long as the calendar and there are as many as plans that differ; they are read by several look-ups.
    return Series(service.plans.unionByName(bought.plans), durable(service.points.unionByName(bought.points)))


def _window_ends() -> dict[str, Column]:
    """The dates at which a plan's cells begin and end."""
    start = F.col("exec_on")
    return {"lo": _from(), "mid": F.date_sub(start, F.floor(F.col("baseline_days") / 2).cast("int")), "start": start, "hi": F.date_add(start, F.col("window_days"))}


def service_moments(scoped: ScopeDays) -> DataFrame:
    """Cell moments of every plan's own service metric and of the guardrails it names: one row per plan and ``series``.

    Plans of one scope share the running sums of a series, so a plan costs four look-ups per series.
    """
    plans = scoped.plans
    own = F.when(F.col("metric").isin(list(SERVICE_METRICS)), F.array("metric"))
    guards = F.filter(F.coalesce("guardrails", F.array()), lambda g: g.isin(list(GUARDRAIL_METRICS)))
    names = F.concat(F.coalesce(own, F.array().cast("array<string>")), F.transform(guards, lambda g: F.concat(F.lit("g_"), g)))
    asks = plans.select(KEY, "scope", F.coalesce("weekly", F.lit(False)).alias("weekly"), "exec_on", "baseline_days", "window_days", F.explode(F.array_distinct(names)).alias("series"))
    wanted = asks.groupBy("scope").agg(F.collect_set(F.struct("series", "weekly")).alias("wanted"))
    cells = F.array(*(F.struct(F.lit(m).alias("name"), F.col(f"t_{m}").alias("t"), F.col(f"c_{m}").alias("c")) for m in METRICS))
    # At most twice as many wishes per scope as there are metrics.
    long = scoped.days.join(wanted, "scope").select("scope", "date", F.inline("wanted"), cells.alias("_cells")).withColumn("_cell", F.filter("_cells", lambda x: x["name"] == F.col("series"))[0])
    long = long.select("scope", "series", "weekly", "date", "_cell.t", "_cell.c").filter(F.col("t").isNotNull() | F.col("c").isNotNull())
    keys = ["scope", "series", "weekly"]
    points = apply_weekly(long, ("scope", "series", "weekly"))
    asked = prefix.ends(asks, keys, _window_ends(), also=[KEY])
    out = prefix.cell_moments(asked, prefix.moments_before(points, asked, keys), keys, [KEY, "series"], CELLS, fit="pre")
    seen = F.lit(0)
    for arm in ("t", "c"):
        for name in CELLS:
            seen = seen + F.col(f"n_{arm}_{name}")
    return out.withColumn("_seen", seen)


def _cells(post_days: Column) -> dict[str, Column]:
    d, start = F.col("date"), F.col("exec_on")
    lo = F.date_sub(start, F.col("baseline_days"))
    mid = F.date_sub(start, F.floor(F.col("baseline_days") / 2).cast("int"))
    return {
        "pre": (d >= lo) & (d < start), "post": (d >= start) & (d < F.date_add(start, post_days)), "p1": (d >= lo) & (d < mid), "p2": (d >= mid) & (d < start),
    }


def _shared_moments(shared: Series, plans: DataFrame) -> DataFrame:
    """``cell_moments`` of plans that share series: six look-ups in running sums per plan, however long its windows."""
    by = [KEY, "exec_on", "baseline_days", "window_days"]
    # A plan declared twice counts its points twice.
    asks = shared.plans.join(plans.select(*by), KEY)
    seen = {"first": week_of("lo"), "past": F.date_add(week_of("hi"), 7)}
    asked = prefix.ends(asks, ["series"], _window_ends() | seen, also=by)
    before = prefix.moments_before(shared.points, asked, ["series"])
    out = prefix.cell_moments(asked, before, ["series"], by, CELLS | {"seen": ("first", "past")}, fit="pre")
    return out.filter(F.col("n_t_seen") + F.col("n_c_seen") > 0).drop(*(f"{k}_{a}_seen" for k in "nmv" for a in "tc"))


def cell_moments(pairs: DataFrame | Series, plans: DataFrame, keys: Sequence[str] = (KEY,), plan_columns: Sequence[str] = ()) -> DataFrame:
    """Count, mean and variance of both arms before, after and in the two halves of the baseline: one aggregate."""
    if isinstance(pairs, Series):
        return _shared_moments(pairs, plans)
    rows = pairs.join(plans.select(KEY, "exec_on", "baseline_days", "window_days", *plan_columns), KEY)
    aggs = []
    for cell, test in _cells(F.col("window_days")).items():
        for arm in ("t", "c"):
            y = F.when(test, F.col(arm))
            aggs += [F.count(y).alias(f"n_{arm}_{cell}"), mean0(y).alias(f"m_{arm}_{cell}"), var0(y).alias(f"v_{arm}_{cell}")]
    both = _cells(F.col("window_days"))["pre"] & F.col("t").isNotNull() & F.col("c").isNotNull()
    fit = pearson0(F.when(both, F.col("t")), F.when(both, F.col("c")), more_than=3)
    return rows.groupBy(*keys, "exec_on", "baseline_days", "window_days", *plan_columns).agg(*aggs, fit.alias("fit"))


def _spread(arm_cells: Sequence[str]) -> Column:
    total = F.lit(0.0)
    for c in arm_cells:
        total = total + F.try_divide(F.col(f"v_{c}"), F.col(f"n_{c}"))
    return F.sqrt(total)


def _planned(*arms: str) -> Column:
    """Standard error that was knowable before the window opened."""
    total = F.lit(0.0)
    for a in arms:
        total = total + F.col(f"v_{a}_pre") * (1 / at_least(F.col(f"n_{a}_post"), 1) + 1 / at_least(F.col(f"n_{a}_pre"), 1))
    return F.sqrt(total)


def did_columns(alpha: float = 0.05) -> dict[str, Column]:
    """Difference-in-differences over cell moments."""
    c = F.col
    ok = (c("n_t_post") >= 2) & (c("n_c_post") >= 2) & (c("n_t_pre") >= 4) & (c("n_c_pre") >= 4)
    df = at_least(c("n_t_post") + c("n_t_pre") + c("n_c_post") + c("n_c_pre") - 4, 4).cast("double")
    halves = ("t_p1", "t_p2", "c_p1", "c_p2")
    usable = F.lit(True)
    for h in halves:
        usable = usable & (c(f"n_{h}") > 1)
    p_point = c("m_t_p2") - c("m_t_p1") - (c("m_c_p2") - c("m_c_p1"))
    p_se = _spread(halves)
    p_df = at_least(c("n_t_p1") + c("n_t_p2") + c("n_c_p1") + c("n_c_p2") - 4, 4)
    p_t = F.when(p_se > 0, F.try_divide(p_point, p_se)).otherwise(F.lit(0.0))
    p_crit = student_t_quantile(0.975, p_df)
    return {
        "ok": ok,
        "point": c("m_t_post") - c("m_t_pre") - (c("m_c_post") - c("m_c_pre")),
        "se": _spread(("t_post", "t_pre", "c_post", "c_pre")),
        "df": df,
        "d_t": c("m_t_post") - c("m_t_pre"),
        "d_c": c("m_c_post") - c("m_c_pre"),
        "placebo_ok": usable,
        "placebo_pass": usable & (p_se > 0) & (F.abs(p_t) <= p_crit),
        "placebo_point": F.when(usable, p_point).otherwise(F.lit(0.0)),
        "placebo_t": F.when(usable, p_t).otherwise(F.lit(0.0)),
        "placebo_crit": F.when(usable, p_crit).otherwise(F.lit(0.0)),
        "pre_fit": c("fit"),
        "se_planned": _planned("t", "c"),
        "index_move": F.lit(None).cast("double"),
        "index_share": F.lit(None).cast("double"),
    }


def reconcile_columns() -> dict[str, Column]:
    """Observed fall of the treated series; the index move is disclosed beside it."""
    c = F.col
    point = c("m_t_pre") - c("m_t_post")
    w = welch_columns(c("v_t_pre"), c("n_t_pre"), c("v_t_post"), c("n_t_post"))
    indexed = (c("n_c_pre") > 0) & (c("n_c_post") > 0)
    move = F.when(indexed, c("m_c_pre") - c("m_c_post")).otherwise(F.lit(0.0))
    zero = F.lit(0.0)
    return {
        "ok": (c("n_t_pre") >= 3) & (c("n_t_post") >= 2),
        "point": point,
        "se": w["se"],
        "df": at_least(w["df"], 3.0),
        "d_t": c("m_t_post") - c("m_t_pre"),
        "d_c": zero,
        "placebo_ok": F.lit(True),
        "placebo_pass": F.lit(True),
        "placebo_point": move,
        "placebo_t": zero,
        "placebo_crit": zero,
        "pre_fit": F.lit(1.0),
        "se_planned": _planned("t"),
        "index_move": move,
        "index_share": F.when(point != 0, F.try_divide(move, point)).otherwise(zero),
    }


def estimate(moments: DataFrame, is_did: Column, alpha: float = 0.05) -> DataFrame:
    """Estimates from cell moments: DiD where ``is_did``, else reconciliation; null figures where refused."""
    a, b = did_columns(alpha), reconcile_columns()
    out = moments.withColumn("_did", is_did)
    out = out.withColumn("ok", F.when(F.col("_did"), a["ok"]).otherwise(b["ok"]))
    for name in a:
        if name != "ok":
            out = out.withColumn(name, F.when(F.col("ok"), F.when(F.col("_did"), a[name]).otherwise(b[name])))
    known = F.col("ok")
    z = normal_quantile_value(1 - alpha / 2) + normal_quantile_value(0.8)
    out = (
        out.withColumn("method", F.when(F.col("_did"), "did").otherwise("reconciliation"))
        .withColumn("refusal", F.when(~known, F.when(F.col("_did"), "insufficient observations").otherwise("insufficient invoice cycles")))
        .withColumn("t_crit", F.when(known, student_t_quantile(1 - alpha, F.col("df"))))
        .withColumn("t_crit2", F.when(known, student_t_quantile(1 - alpha / 2, F.col("df"))))
        .withColumn("mde", F.col("se_planned") * z)
    )
    return _bounds(out).drop("_did")


def _bounds(out: DataFrame) -> DataFrame:
    p, se = F.col("point"), F.col("se")
    return (
        out.withColumn("lower", p - F.col("t_crit") * se)
        .withColumn("upper", p + F.col("t_crit") * se)
        .withColumn("ci_lo", p - F.col("t_crit2") * se)
        .withColumn("ci_hi", p + F.col("t_crit2") * se)
    )


def did(pairs: DataFrame | Series, plans: DataFrame, alpha: float = 0.05) -> DataFrame:
    return estimate(cell_moments(pairs, plans), F.lit(True), alpha)


def reconcile(pairs: DataFrame | Series, plans: DataFrame, alpha: float = 0.05) -> DataFrame:
    return estimate(cell_moments(pairs, plans), F.lit(False), alpha)


def measure_interventions(scoped: ScopeDays, invoices: DataFrame, item_days: DataFrame, menu: DataFrame, as_of: Day, moments: DataFrame | None = None) -> DataFrame:
    """The estimate each plan named. Interventions without any series point are kept and refused.

    ``moments``: the plans' ``service_moments``, if they were made before.
    """
    plans = scoped.plans
    moments = service_moments(scoped) if moments is None else moments
    own = moments.join(plans.select(KEY, F.col("metric").alias("series")), [KEY, "series"]).filter(F.col("_seen") > 0).drop("series", "_seen")
    spans = series_spans(plans, invoices, item_days, as_of, whole=False)
    bought = cell_moments(bought_series(plans, invoices, item_days, menu, spans), plans).drop("exec_on", "baseline_days", "window_days")
    both = own.unionByName(bought).join(plans.select(KEY, "estimator"), KEY)
    out = estimate(both, F.col("estimator") == "did").drop("estimator")
    return plans.select(KEY).join(out, KEY, "left").withColumn("ok", F.coalesce("ok", F.lit(False)))


def _summed(points: DataFrame, asks: DataFrame, keys: Sequence[str], sums: Sequence[str]) -> DataFrame:
    """Sums of each ask's series from execution to the end of its window: one row per plan and series."""
    asked = prefix.ends(asks, keys, {"start": F.col("exec_on"), "hi": F.date_add("exec_on", F.col("window_days"))}, also=[KEY])
    return prefix.between(asked, prefix.sums_before(points, asked, keys, sums), keys, [KEY, *keys], {"post": ("start", "hi")}, sums)


def window_volume(scoped: ScopeDays, invoices: DataFrame, item_days: DataFrame, menu: DataFrame) -> DataFrame:
    """Covers, services, units, plates or SKU quantity inside the measurement window; plans that saw none have no row."""
    window = scoped.plans.select(KEY, "scope", "grain", "exec_on", "window_days", "treat_sku", "treat_locs", "treat_items")
    scope = _summed(scoped.days.select("scope", "date", "covers", "services"), window.filter(F.col("grain").isin("cover", "service")), ["scope"], ["covers", "services"])
    amount = F.when(F.col("grain") == "cover", F.col("covers_post")).otherwise(F.col("services_post"))
    parts = scope.join(window.select(KEY, "grain"), KEY).filter(F.col("services_post") > 0).select(KEY, amount.cast("double").alias("volume"))
    sold = item_days.groupBy("loc", "item", "date").agg(F.sum("units").alias("units"))
    total = lambda rows, c: rows.groupBy(KEY).agg(F.sum(f"{c}_post").cast("double").alias("volume")).filter(F.col("volume") != 0)
    one = lambda grain, *cols: window.filter(F.col("grain") == grain).select(KEY, "exec_on", "window_days", *cols)
    by_item = one("unit", F.col("treat_locs")[0].alias("loc"), F.explode("treat_items").alias("item"))
    units = total(_summed(sold, by_item, ["loc", "item"], ["units"]), "units")
    used = sold.join(costing.linked_items(menu), "item").groupBy("loc", "sku", "date").agg(F.sum("units").alias("units"))
    by_sku = one("sku_unit", F.col("treat_sku").alias("sku"), F.explode("treat_locs").alias("loc"))
    plates = total(_summed(used, by_sku, ["loc", "sku"], ["units"]), "units")
    bought = invoices.groupBy("sku", F.col("week").alias("date")).agg(F.sum("qty").alias("qty"))
    quantity = total(_summed(bought, one("sku", F.col("treat_sku").alias("sku")), ["sku"], ["qty"]), "qty")
    return parts.unionByName(units).unionByName(plates).unionByName(quantity)


def observed_services(scoped: ScopeDays, as_of: Day) -> DataFrame:
    """Services seen in each plan's treated rooms from execution to ``as_of``."""
    asked = prefix.ends(scoped.plans, ["scope"], {"start": F.col("exec_on"), "today": F.greatest(F.col("exec_on"), day(to_date(as_of)))}, also=[KEY])
    before = prefix.sums_before(scoped.days.select("scope", "date", "services"), asked, ["scope"], ["services"])
    seen = prefix.between(asked, before, ["scope"], [KEY], {"open": ("start", "today")}, ["services"])
    return seen.select(KEY, F.col("services_open").alias("observed"))


def scale_to_week(estimates: DataFrame, plans: DataFrame, volume: DataFrame, as_of: Day) -> DataFrame:
    """Estimates in cents per week, positive where money is saved."""
    span = F.greatest(F.lit(1), F.least(F.col("window_days"), F.datediff(day(to_date(as_of)), F.col("exec_on"))))
    weeks = F.greatest(F.lit(1), F.floor(span / 7 + 0.5))
    amount = F.coalesce("volume", F.lit(0.0))
    factor = F.when(F.col("grain") == "sku", amount / weeks).otherwise(amount / span * 7)
    sign = F.when(F.col("estimator") == "reconcile", 1).when(F.col("direction") == "down_is_saving", -1).otherwise(1)
    meta = plans.select(KEY, "exec_on", "window_days", "grain", "direction", "estimator")
    rows = estimates.drop("exec_on", "window_days", "baseline_days", "estimator", "lower", "upper", "ci_lo", "ci_hi").join(meta, KEY).join(volume, KEY, "left")
    rows = rows.withColumn("week_factor", factor).withColumn("sign", sign).withColumn("raw_point", F.col("point")).withColumn("raw_se", F.col("se"))
    rows = (
        rows.withColumn("point", F.col("raw_point") * F.col("sign") * F.col("week_factor"))
        .withColumn("se", F.col("raw_se") * F.col("week_factor"))
        .withColumn("mde", F.col("mde") * F.col("week_factor"))
    )
    return _bounds(rows).drop("volume", "exec_on", "window_days", "grain", "direction", "estimator")
