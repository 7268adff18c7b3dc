"""Seven detectors: one row per examined unit with every measure and a ``fired`` flag."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .. import dims
from ..functions.dates import weeks_back
from ..functions.numeric import at_least, mean0, round_cents, student_t_quantile
from ..functions.text import finding_id, slug
from ..session import attach
from . import costing, labour, spc
from .series import comps_rate, last_n

Day = str | dt.date


@dataclass(frozen=True)
class Thresholds:
    """Minimum evidence and size of every detector; the defaults are the engine's policy."""

    hours_services: int = 12
    hours_peers: int = 40
    hours_side: int = 6
    hours_delta: float = 4.5
    hours_cents: int = 9000
    rate_rel_se: float = 0.08
    price_rows: int = 20
    price_pre: int = 4
    price_post: int = 3
    price_cents: int = 8000
    usage_rows: int = 16
    usage_pre: int = 4
    usage_post: int = 3
    usage_cents: int = 6000
    comps_services: int = 40
    comps_signals: int = 8
    comps_cents: int = 5000
    menu_rows: int = 120
    menu_prices: int = 3
    menu_weeks: int = 24
    menu_cents: int = 5000
    mix_rows: int = 200
    mix_cents: int = 9000
    ticket_services: int = 40
    ticket_pre: int = 12
    ticket_post: int = 8
    ticket_minutes: float = 1.5


DEFAULTS = Thresholds()


def _flag(test: Column) -> Column:
    return F.coalesce(test, F.lit(False))


def _since(df: DataFrame, as_of: Day, weeks: int, column: str = "date") -> DataFrame:
    return df.filter(F.col(column) >= F.lit(weeks_back(as_of, weeks)))


def _before_after(series: DataFrame, onsets: DataFrame, by: Sequence[str], measures: dict[str, str]) -> DataFrame:
    """Counts and means before the onset and from the signal on; series without a signal keep null sides."""
    joined = series.join(onsets, list(by), "left")
    pre = F.col("date") < F.col("onset_date")
    post = F.col("date") >= F.col("signal_date")
    cols = [F.count(F.when(pre, 1)).alias("n_pre"), F.count(F.when(post, 1)).alias("n_post")]
    for name, column in measures.items():
        cols.append(F.avg(F.when(pre, F.col(column))).alias(f"{name}0"))
        cols.append(F.avg(F.when(post, F.col(column))).alias(f"{name}1"))
    return joined.groupBy(*by).agg(F.max("onset_date").alias("onset_date"), F.max("signal_date").alias("signal_date"), *cols)


def excess_rows(services: DataFrame, role_shifts: DataFrame, dayparts: DataFrame, as_of: Day, server_roles: Sequence[str], th: Thresholds):
    """Services of the last 26 weeks with paid, required and excess hours against their peers' rate."""
    recent = _since(services, as_of, 26)
    staffed = labour.staffed_services(recent, _since(role_shifts, as_of, 26), server_roles)
    unit = ["loc", "daypart", "dow"]
    rates = labour.service_rate(labour.other_weekdays(staffed), unit, th.rate_rel_se)
    need = labour.required_hours(F.col("covers"), F.col("daypart_hours"), F.col("mu"), F.col("roster_ratio"))
    rows = (
        staffed.join(dayparts.select("daypart", F.col("hours").alias("daypart_hours")), "daypart")
        .join(rates.select(*unit, F.col("n_all").alias("peers"), "mu", "rel_se", "roster_ratio"), unit, "left")
        .withColumn("required", need)
        .withColumn("v", F.col("total_hours") - F.col("required"))
    )
    return rows


def detect_excess_hours(
    services: DataFrame, role_shifts: DataFrame, dayparts: DataFrame, as_of: Day,
    server_roles: Sequence[str] = ("server",), th: Thresholds = DEFAULTS,
) -> DataFrame:
    """Paid hours above what the room's own marginal rate needs, per room, daypart and weekday."""
    unit = ["loc", "daypart", "dow"]
    rows = excess_rows(services, role_shifts, dayparts, as_of, server_roles, th)
    split = F.lit(weeks_back(as_of, 12))
    late, early = F.col("date") >= split, F.col("date") < split
    measures = rows.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("services"),
        F.max("peers").alias("peers"),
        F.max("mu").alias("mu"),
        F.max("roster_ratio").alias("roster_ratio"),
        F.count(F.when(late, 1)).alias("n_recent"),
        F.count(F.when(early, 1)).alias("n_prior"),
        (F.avg(F.when(late, F.col("v"))) - F.avg(F.when(early, F.col("v")))).alias("delta_hours"),
        F.avg(F.when(late, F.col("cost_cents") / at_least(F.col("total_hours"), 1.0))).alias("blended_rate"),
        F.avg(F.when(late, F.col("total_hours"))).alias("actual"),
        F.avg(F.when(late, F.col("required"))).alias("baseline"),
    )
    size = W.partitionBy(*unit)
    charted = rows.filter(F.col("mu").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(size))
    chart = spc.cusum_chart(charted, unit, baseline_n=F.least(F.lit(14), F.col("_n") - 6).cast("int"))
    onsets = spc.drift_onset(chart, unit, "high").select(*unit, "onset_date", "signal_date")
    out = measures.join(onsets, unit, "left").withColumn("exposure_cents", round_cents(F.col("delta_hours") * F.col("blended_rate")))
    fired = (
        (F.col("services") >= th.hours_services)
        & (F.col("peers") >= th.hours_peers)
        & F.col("mu").isNotNull()
        & (F.col("n_recent") >= th.hours_side)
        & (F.col("n_prior") >= th.hours_side)
        & (F.col("delta_hours") >= th.hours_delta)
        & F.col("signal_date").isNotNull()
        & (F.col("exposure_cents") >= th.hours_cents)
    )
    return out.withColumn("cut_hours", round_cents(F.col("delta_hours") * 0.75)).withColumn("fired", _flag(fired))


def detect_price_variance(invoices: DataFrame, as_of: Day, th: Thresholds = DEFAULTS) -> DataFrame:
    """A sustained step of a SKU's paid unit price, per SKU over all rooms."""
    recent = _since(invoices, as_of, 26, "week")
    size = recent.groupBy("sku").agg(F.count(F.lit(1)).alias("lines"), F.array_sort(F.collect_set("loc")).alias("locs"))
    weekly = costing.weekly_unit_price(recent)
    onsets = spc.drift_onset(spc.cusum_chart(weekly, ["sku"], baseline_n=10), ["sku"], "high").select("sku", "onset_date", "signal_date")
    out = _before_after(weekly, onsets, ["sku"], {"p": "v", "q": "qty"}).join(size, "sku")
    price_leg, quantity_leg = costing.price_quantity_legs(F.col("p0"), F.col("p1"), F.col("q0"), F.col("q1"))
    out = out.withColumn("price_leg", price_leg).withColumn("quantity_leg", quantity_leg)
    fired = (
        (F.col("lines") >= th.price_rows)
        & F.col("signal_date").isNotNull()
        & (F.col("n_pre") >= th.price_pre)
        & (F.col("n_post") >= th.price_post)
        & (F.col("price_leg") >= th.price_cents)
    )
    return out.withColumn("exposure_cents", round_cents(F.col("price_leg"))).withColumn("fired", _flag(fired))


def detect_usage_drift(
    invoices: DataFrame, item_days: DataFrame, menu: DataFrame, skus: DataFrame, as_of: Day, th: Thresholds = DEFAULTS
) -> DataFrame:
    """More of a SKU bought than the plates sold explain, per room and linked SKU."""
    unit = ["loc", "sku"]
    recent = _since(invoices, as_of, 26, "week").join(skus.select("sku"), "sku", "left_semi")
    weekly = costing.purchased_vs_theoretical(recent, _since(item_days, as_of, 27), menu)
    size = weekly.groupBy(*unit).agg(F.sum("lines").alias("lines"))
    onsets = spc.drift_onset(spc.cusum_chart(weekly, unit, baseline_n=10), unit, "high").select(*unit, "onset_date", "signal_date")
    recipes = costing.linked_items(menu).groupBy("sku").agg(F.array_sort(F.collect_list("item")).alias("items"))
    out = _before_after(weekly, onsets, unit, {"r": "v", "theoretical": "theoretical", "price": "price"}).join(size, unit).join(recipes, "sku")
    out = out.withColumn("excess_qty", F.col("theoretical1") * (F.col("r1") - F.col("r0")))
    out = out.withColumn("exposure_cents", round_cents(F.col("excess_qty") * F.col("price1")))
    fired = (
        (F.col("lines") >= th.usage_rows)
        & F.col("signal_date").isNotNull()
        & (F.col("n_post") >= th.usage_post)
        & (F.col("n_pre") >= th.usage_pre)
        & (F.col("exposure_cents") >= th.usage_cents)
    )
    return out.drop("theoretical0", "price0").withColumn("fired", _flag(fired))


def peer_comps(services: DataFrame) -> DataFrame:
    """Pooled comps rate of the other rooms, per room, daypart and date.

    Each (room, daypart) is laid out over the calendar and meets the total of its daypart on
    each day, from which its own row is taken out: no self-join on rooms, and no join on dayparts alone.
    """
    totals = services.groupBy("daypart", "date").agg(
        F.sum("comps_cents").alias("_comps"), F.sum("gross_cents").alias("_gross"), F.count(F.lit(1)).alias("_rooms")
    )
    own = services.select("loc", "daypart", "date", "comps_cents", "gross_cents")
    units = own.select("loc", "daypart").distinct()
    calendar = attach(units, totals.agg(F.min("date").alias("_lo"), F.max("date").alias("_hi")))
    days = calendar.filter(F.col("_lo").isNotNull()).select("loc", "daypart", F.explode(F.sequence("_lo", "_hi")).alias("date"))
    grid = days.join(totals, ["daypart", "date"]).join(own, ["loc", "daypart", "date"], "left")
    grid = grid.withColumn("_peers", F.col("_rooms") - F.when(F.col("gross_cents").isNotNull(), 1).otherwise(0))
    comps = F.col("_comps") - F.coalesce("comps_cents", F.lit(0))
    gross = F.col("_gross") - F.coalesce("gross_cents", F.lit(0))
    rate = F.when(gross > 0, F.try_divide(comps, gross)).otherwise(F.lit(0.0))
    return grid.filter(F.col("_peers") > 0).select("loc", "daypart", "date", rate.alias("v"))


def detect_comps_rate(services: DataFrame, as_of: Day, th: Thresholds = DEFAULTS) -> DataFrame:
    """Comps above the room's own limits, standing down where the other rooms breach as well."""
    unit = ["loc", "daypart"]
    recent = _since(services, as_of, 26)
    series = recent.select(*unit, "date", comps_rate().alias("v"), "gross_cents")
    chart = spc.ewma_chart(series, unit)
    last = last_n(chart, 28, unit)
    high = F.count(F.when(F.col("signal") == "high", 1))
    week = F.col("date") >= F.lit(weeks_back(as_of, 1))
    own = last.groupBy(*unit).agg(
        F.max("n").alias("services"), high.alias("signals"), F.avg("z").alias("mean_z"), F.avg("v").alias("actual"),
        F.max("mu").alias("baseline"), F.count(F.lit(1)).alias("n_recent"),
    )
    gross = series.groupBy(*unit).agg(F.coalesce(F.sum(F.when(week, F.col("gross_cents"))), F.lit(0)).alias("week_gross"))
    peers = last_n(spc.ewma_chart(peer_comps(recent), unit), 28, unit).groupBy(*unit).agg(
        F.max("n").alias("peer_dates"), high.alias("peer_signals")
    )
    onsets = spc.drift_onset(spc.cusum_chart(series, unit), unit, "high").select(*unit, "onset_date", "signal_date")
    out = own.join(gross, unit).join(peers, unit, "left").join(onsets, unit, "left")
    out = out.withColumn("excess_rate", F.col("mean_z") - F.col("baseline"))
    out = out.withColumn("exposure_cents", round_cents(F.col("excess_rate") * F.col("week_gross")))
    out = out.withColumn("peers_breach", _flag((F.col("peer_dates") >= th.comps_services) & (F.col("peer_signals") >= th.comps_signals)))
    fired = (
        (F.col("services") >= th.comps_services)
        & (F.col("signals") >= th.comps_signals)
        & ~F.col("peers_breach")
        & (F.col("exposure_cents") >= th.comps_cents)
    )
    return out.drop("mean_z").withColumn("fired", _flag(fired))


def detect_underpriced_item(item_days: DataFrame, services: DataFrame, menu: DataFrame, as_of: Day, th: Thresholds = DEFAULTS) -> DataFrame:
    """Items still gaining contribution at their price, from their own price history, per room and item."""
    unit = ["loc", "item"]
    costed = menu.filter(F.col("cost_cents") > 0).select("item")
    rows = _since(item_days, as_of, 52).join(costed, "item", "left_semi")
    size = rows.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("price_cents").alias("prices"), F.max("price_cents").alias("max_price")
    )
    weekly = costing.units_per_cover(rows, services).withColumn("ln_u", F.log("per_cover")).withColumn("ln_p", F.log("price"))
    ranked = weekly.withColumn("_r", F.row_number().over(W.partitionBy(*unit).orderBy(F.col("date").desc())))
    x, y = F.col("ln_p"), F.col("ln_u")
    fit = ranked.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("weeks"),
        F.regr_sxx(y, x).alias("_sxx"), F.regr_syy(y, x).alias("_syy"), F.regr_sxy(y, x).alias("_sxy"),
        F.max(F.when(F.col("_r") == 1, F.col("price"))).alias("price"),
        F.max(F.when(F.col("_r") == 1, F.col("cost"))).alias("cost"),
        F.avg(F.when(F.col("_r") <= 8, F.col("units"))).alias("units_now"),
    )
    spread = F.col("_sxx") > 1e-9
    rss = at_least(F.col("_syy") - F.try_divide(F.col("_sxy") * F.col("_sxy"), F.col("_sxx")), 0.0)
    out = size.join(fit, unit)
    out = out.withColumn("elasticity", F.when(spread, F.try_divide("_sxy", "_sxx")).otherwise(F.lit(0.0)))
    out = out.withColumn(
        "se", F.when(spread, F.sqrt(F.try_divide(F.try_divide(rss, F.col("weeks") - 2), F.col("_sxx")))).otherwise(F.lit(99.0))
    ).drop("_sxx", "_syy", "_sxy")
    e, price, cost = F.col("elasticity"), F.col("price"), F.col("cost")
    elastic = e < -1.0
    out = out.withColumn("p_star", F.when(elastic, F.try_divide(cost * e, 1 + e)))
    out = out.withColumn("slope_of_margin", price * (1 + e) - cost * e)
    step = F.least(F.col("p_star"), price * 1.08, F.col("max_price") * 1.25)
    out = out.withColumn("target", F.when(elastic, F.floor(step / 25 + 0.5) * 25))
    out = out.withColumn("t_crit", student_t_quantile(0.95, F.col("weeks") - 2))

    def gain(elasticity: Column) -> Column:
        ratio = F.try_divide(F.col("target"), price)
        now = (price - cost) * F.col("units_now")
        return round_cents((F.col("target") - cost) * F.col("units_now") * F.pow(ratio, elasticity) - now)

    wide = F.col("t_crit") * F.col("se")
    out = (
        out.withColumn("exposure_cents", gain(e)).withColumn("low_cents", gain(e - wide)).withColumn("high_cents", gain(e + wide))
    )
    fired = (
        (F.col("rows") >= th.menu_rows)
        & (F.col("prices") >= th.menu_prices)
        & (F.col("weeks") >= th.menu_weeks)
        & (F.col("se") < F.abs(e) / 2)
        & elastic
        & (F.col("slope_of_margin") > 0)
        & (F.col("target") > price)
        & (F.col("exposure_cents") >= th.menu_cents)
    )
    return out.withColumn("extrapolating", _flag(F.col("p_star") > F.col("max_price") * 1.25)).withColumn("fired", _flag(fired))


def mix_effects(item_days: DataFrame, as_of: Day) -> DataFrame:
    """Mix, margin and cross effect of every item at every room, net of the other rooms' mix.

    The other rooms are the group's total less the room's own, by joins on totals.
    """
    late = F.col("date") >= F.lit(weeks_back(as_of, 8))
    margin = F.col("price_cents") - F.col("cost_cents")
    items = _since(item_days, as_of, 16).groupBy("loc", "item").agg(
        F.sum(F.when(~late, F.col("units")).otherwise(0)).alias("u0"), F.sum(F.when(late, F.col("units")).otherwise(0)).alias("u1"),
        mean0(F.when(~late, margin)).alias("m0"), mean0(F.when(late, margin)).alias("m1"),
        F.count(F.when(~late, 1)).alias("r0"), F.count(F.when(late, 1)).alias("r1"),
    )
    sums = lambda prefix: [F.sum(c).alias(prefix + c) for c in ("u0", "u1", "r0", "r1")]
    rooms = items.groupBy("loc").agg(*sums("room_"))
    group_items = items.groupBy("item").agg(F.sum("u0").alias("item_u0"), F.sum("u1").alias("item_u1"))
    group = rooms.select(*(F.col(f"room_{c}").alias(c) for c in ("u0", "u1", "r0", "r1"))).agg(*sums("all_"))
    out = attach(items.join(rooms, "loc").join(group_items, "item"), group)

    def peer_share(side: str) -> Column:
        own = F.col(f"item_u{side}") - F.col(f"u{side}")
        return F.coalesce(F.try_divide(own, F.col(f"all_u{side}") - F.col(f"room_u{side}")), F.lit(0.0))

    compared = (F.col("all_r0") > F.col("room_r0")) & (F.col("all_r1") > F.col("room_r1"))
    shift = F.when(compared, peer_share("1") - peer_share("0")).otherwise(F.lit(0.0))
    share = lambda side: F.coalesce(F.try_divide(f"u{side}", f"room_u{side}"), F.lit(0.0))
    out = out.withColumn("share_pre", share("0")).withColumn("share_now", share("1"))
    out = out.withColumn("d_share", F.col("share_now") - F.col("share_pre") - shift).withColumn("d_margin", F.col("m1") - F.col("m0"))
    return out.select(
        "loc", "item", "share_pre", "share_now", "d_share", "d_margin",
        (F.col("d_share") * F.col("m0")).alias("mix_effect"),
        (F.col("share_now") * F.col("d_margin")).alias("cm_effect"),
        (F.col("d_share") * F.col("d_margin")).alias("cross_effect"),
        "room_u1", "room_r0", "room_r1",
    )


def detect_mix_shift(item_days: DataFrame, as_of: Day, th: Thresholds = DEFAULTS) -> DataFrame:
    """A mix drifting towards lower margins over eight weeks against the eight before, per room."""
    out = mix_effects(item_days, as_of).groupBy("loc").agg(
        F.sum("mix_effect").alias("mix_effect"), F.sum("cm_effect").alias("cm_effect"), F.sum("cross_effect").alias("cross_effect"),
        (F.max("room_u1") / 8).alias("weekly_units"), F.max("room_r0").alias("rows_pre"), F.max("room_r1").alias("rows_post"),
    )
    weekly = round_cents(F.col("mix_effect") * F.col("weekly_units"))
    out = out.withColumn("weekly_cents", weekly).withColumn("exposure_cents", F.abs(F.col("weekly_cents")))
    fired = (F.col("rows_pre") >= th.mix_rows) & (F.col("rows_post") >= th.mix_rows) & (F.col("weekly_cents") <= -th.mix_cents)
    return out.withColumn("fired", _flag(fired))


def top_drivers(effects: DataFrame, n: int = 6) -> DataFrame:
    """The most negative mix effects of every room."""
    w = W.partitionBy("loc").orderBy("mix_effect", "item")
    return effects.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def detect_ticket_drift(
    services: DataFrame, item_days: DataFrame, as_of: Day, feeds: DataFrame | None = None, th: Thresholds = DEFAULTS
) -> DataFrame:
    """Slower tickets, valued through the share of time the room is full, per room and daypart."""
    unit = ["loc", "daypart"]
    recent = _since(services, as_of, 26)
    series = recent.select(*unit, "date", F.col("ticket_min").alias("v"))
    onsets = spc.drift_onset(spc.cusum_chart(series, unit), unit, "high").select(*unit, "onset_date", "signal_date")
    eight, one = F.lit(weeks_back(as_of, 8)), F.lit(weeks_back(as_of, 1))
    size = recent.groupBy(*unit).agg(
        F.count(F.lit(1)).alias("services"),
        mean0(F.when(F.col("date") >= eight, F.col("constrained_share"))).alias("constrained_share"),
        F.coalesce(F.sum(F.when(F.col("date") >= one, F.col("covers"))), F.lit(0)).alias("weekly_covers"),
    )
    margin = costing.cm_per_cover(_since(item_days, as_of, 8), _since(services, as_of, 8))
    out = _before_after(series, onsets, unit, {"t": "v"}).join(size, unit).join(margin, "loc", "left")
    out = out.fillna(0.0, ["cm_per_cover"]).withColumn("delta_min", F.col("t1") - F.col("t0"))
    value = F.col("delta_min") / 60 * 0.8 * F.col("constrained_share") * F.col("cm_per_cover") * F.col("weekly_covers") * 0.35
    out = out.withColumn("exposure_cents", F.greatest(F.lit(0), round_cents(value)))
    fired = (
        (F.col("services") >= th.ticket_services)
        & F.col("signal_date").isNotNull()
        & (F.col("n_post") >= th.ticket_post)
        & (F.col("n_pre") >= th.ticket_pre)
        & (F.col("delta_min") >= th.ticket_minutes)
    )
    out = out.withColumn("fired", _flag(fired))
    if feeds is None:
        return out.withColumn("blocked", F.lit(False))
    stale = feeds.filter(F.col("code") == "reservations").agg(F.coalesce(F.max("stale"), F.lit(False)).alias("blocked"))
    return attach(out, stale)


def findings_of(code: str, detected: DataFrame, as_of: Day) -> DataFrame:
    """The fired units of one detector in the common finding layout."""
    lever, account, equations, feeds, effort, risk, latency, guards, autonomy, cadence = dims.DETECTORS[code]
    has = set(detected.columns)
    pick = lambda name, kind: (F.col(name) if name in has else F.lit(None)).cast(kind)
    short_day = F.element_at(F.array(*(F.lit(x) for x in ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT"))), pick("dow", "int") + 1)
    ids = {
        "LAB": lambda: finding_id("LAB", slug(F.col("loc")), slug(F.col("daypart")), short_day),
        "PPV": lambda: finding_id("PPV", slug(F.col("sku"))),
        "POR": lambda: finding_id("POR", slug(F.col("loc")), slug(F.col("sku"))),
        "CMP": lambda: finding_id("CMP", slug(F.col("loc")), slug(F.col("daypart"))),
        "PRC": lambda: finding_id("PRC", slug(F.col("loc")), slug(F.col("item"))),
        "MIX": lambda: finding_id("MIX", slug(F.col("loc"))),
        "TKT": lambda: finding_id("TKT", slug(F.col("loc")), slug(F.col("daypart"))),
    }
    evidence = {"LAB": "n_recent", "PPV": "n_post", "POR": "n_post", "CMP": "n_recent", "PRC": "weeks", "TKT": "n_post"}
    strings = lambda values: F.array(*(F.lit(v) for v in values))
    loc = F.col("loc") if "loc" in has else F.lit("group")
    locs = F.col("locs") if "locs" in has else F.array(F.col("loc"))
    return detected.filter("fired").select(
        ids[code]().alias("id"),
        F.lit(code).alias("detector"),
        F.lit(lever).alias("lever"),
        F.lit(dims.LEVERS[lever][0]).alias("family"),
        F.lit(dims.LEVERS[lever][1]).alias("domain"),
        loc.alias("loc"),
        locs.alias("locs"),
        pick("daypart", "string").alias("daypart"),
        pick("dow", "int").alias("dow"),
        pick("sku", "string").alias("sku"),
        (F.col("items") if "items" in has else F.array("item") if "item" in has else F.lit(None)).cast("array<string>").alias("items"),
        F.lit(account).alias("account"),
        strings(equations).alias("equations"),
        strings(feeds).alias("feeds"),
        F.col("exposure_cents").cast("bigint").alias("exposure_cents"),
        (F.col(evidence[code]) if code in evidence else F.lit(8)).cast("int").alias("evidence_count"),
        F.lit(cadence).alias("cadence_days"),
        F.lit(effort).alias("effort_hours"),
        F.lit(risk).alias("risk"),
        F.lit(latency).alias("latency_days"),
        strings(guards).alias("guardrails"),
        F.lit(autonomy).alias("autonomy"),
        pick("onset_date", "date").alias("onset_date"),
        pick("signal_date", "date").alias("signal_date"),
        F.coalesce(pick("blocked", "boolean"), F.lit(False)).alias("blocked"),
        F.when(F.lit(code == "MIX"), F.lit("modelled")).alias("claim_ceiling"),
        pick("p0", "double").alias("p0"),
        pick("p1", "double").alias("p1"),
        pick("excess_qty", "double").alias("excess_qty"),
    )
