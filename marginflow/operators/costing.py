"""Prices, usage, mix and margins derived from invoices and item-days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import week_of
from ..functions.numeric import at_least
from . import prefix

KEY = "intervention_id"


def weekly_unit_price(invoices: DataFrame) -> DataFrame:
    """Paid price and quantity per SKU and week."""
    return invoices.groupBy("sku", F.col("week").alias("date")).agg(
        (F.sum("extended_cents") / F.greatest(F.sum("qty"), F.lit(1e-9))).alias("v"), F.sum("qty").alias("qty")
    )


def weekly_invoices(invoices: DataFrame) -> DataFrame:
    """Invoice lines added up by room, SKU and week, for series and volumes that are made of sums: ``lines`` of them in each row."""
    return invoices.groupBy("loc", "sku", "week").agg(*(F.sum(c).alias(c) for c in ("qty", "extended_cents", "unit_price_cents")), F.count(F.lit(1)).alias("lines"))


def _lines(invoices: DataFrame) -> Column:
    """How many lines invoices are, or what was added up of them."""
    return (F.sum("lines") if "lines" in invoices.columns else F.count(F.lit(1))).alias("lines")


def linked_items(menu: DataFrame) -> DataFrame:
    """Recipe bridge: items that draw on a SKU."""
    return menu.filter(F.col("uses_sku").isNotNull()).select("item", F.col("uses_sku").alias("sku"), "qty_per_unit")


def weekly_plates(item_days: DataFrame, menu: DataFrame) -> DataFrame:
    """Plates sold and SKU quantity they should have used, per room, SKU and week.

    Invoice weeks are Mondays, so the week range of an invoice is an equality on the week.
    """
    return (
        item_days.join(linked_items(menu), "item")
        .groupBy("loc", "sku", week_of("date").alias("date"))
        .agg(F.sum("units").alias("plates"), F.sum(F.col("units") * F.col("qty_per_unit")).alias("theoretical"))
    )


def purchased_vs_theoretical(invoices: DataFrame, item_days: DataFrame, menu: DataFrame) -> DataFrame:
    """Weekly bought ÷ theoretical usage of linked SKUs, 1 where nothing was sold."""
    linked = linked_items(menu).select("sku").distinct()
    bought = (
        invoices.join(linked, "sku", "left_semi")
        .groupBy("loc", "sku", F.col("week").alias("date"))
        .agg(F.sum("qty").alias("bought"), F.avg("unit_price_cents").alias("price"), F.count(F.lit(1)).alias("lines"))
    )
    used = weekly_plates(item_days, menu).select("loc", "sku", "date", "theoretical")
    out = bought.join(used, ["loc", "sku", "date"], "left").withColumn("theoretical", F.coalesce("theoretical", F.lit(0.0)))
    ratio = F.when(F.col("theoretical") > 0, F.try_divide("bought", "theoretical")).otherwise(F.lit(1.0))
    return out.withColumn("v", ratio)


def covers_by_week(services: DataFrame) -> DataFrame:
    return services.groupBy("loc", week_of("date").alias("date")).agg(F.sum("covers").alias("covers"))


def units_per_cover(item_days: DataFrame, services: DataFrame) -> DataFrame:
    """Weekly units of an item per cover of its room, with the unweighted mean price and cost of its rows."""
    weekly = item_days.groupBy("loc", "item", week_of("date").alias("date")).agg(
        F.sum("units").alias("units"), F.avg("price_cents").alias("price"), F.avg("cost_cents").alias("cost")
    )
    return (
        weekly.filter(F.col("units") > 0)
        .join(covers_by_week(services), ["loc", "date"], "left")
        .withColumn("per_cover", F.col("units") / at_least(F.coalesce("covers", F.lit(1)), 1))
    )


def mix_shares(item_days: DataFrame) -> DataFrame:
    """Per room and item: share of the room's units, mean unit margin of its rows, units."""
    items = item_days.groupBy("loc", "item").agg(
        F.sum("units").alias("units"), F.avg(F.col("price_cents") - F.col("cost_cents")).alias("unit_margin")
    )
    rooms = items.groupBy("loc").agg(F.sum("units").alias("room_units"))
    return items.join(rooms, "loc").select("loc", "item", F.try_divide("units", "room_units").alias("share"), "unit_margin", "units")


def cm_per_cover(item_days: DataFrame, services: DataFrame) -> DataFrame:
    """Contribution per cover and room; 0 where a room had no covers."""
    margin = item_days.groupBy("loc").agg(F.sum(F.col("units") * (F.col("price_cents") - F.col("cost_cents"))).alias("margin"))
    covers = services.groupBy("loc").agg(F.sum("covers").alias("covers"))
    value = F.when(F.col("covers") > 0, F.try_divide(F.coalesce("margin", F.lit(0)), F.col("covers"))).otherwise(F.lit(0.0))
    return covers.join(margin, "loc", "left").select("loc", value.alias("cm_per_cover"))


def price_quantity_legs(p0, p1, q0, q1):
    """Price leg and quantity leg of a change of spend."""
    return (p1 - p0) * q1, (q1 - q0) * p0


def in_weeks(asks: DataFrame, spans: DataFrame) -> DataFrame:
    """Each ask once per Monday of its plan's span, so that it meets weekly facts by equality."""
    mondays = F.explode(F.sequence(week_of("lo"), week_of("hi"), F.expr("interval 7 days")))
    return asks.join(spans, KEY).withColumn("week", mondays).drop("lo", "hi")


def shown(asks: DataFrame, points: DataFrame, spans: DataFrame) -> DataFrame:
    """The points of each ask's ``series`` in the weeks of its plan's span.

    ``asks``: (intervention_id, series, ...); ``points``: (series, date, ...), made once however many plans show them. They
    meet by (series, month), so no task holds a plan's or a series' whole calendar.
    """
    months = F.explode(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month")))
    reach = spans.groupBy(KEY).agg(week_of(F.min("lo")).alias("lo"), F.date_add(week_of(F.max("hi")), 6).alias("hi"))
    asked = asks.join(reach, KEY).withColumn("_month", months)
    met = asked.join(points.withColumn("_month", F.trunc("date", "month")), ["series", "_month"])
    return met.filter(F.col("date").between(F.col("lo"), F.col("hi"))).drop("_month", "lo", "hi")


def series_of(*parts: str) -> Column:
    """A digest of what a series depends on."""
    return F.md5(F.to_json(F.struct(*parts), {"ignoreNullFields": "false"})).alias("series")


def _basket_bases(baskets: DataFrame, weekly: DataFrame) -> DataFrame:
    """Mean line price of each basket SKU before execution, from running sums of its weeks; 1 where there was none."""
    by = ["series", "pos", "sku"]
    asked = baskets.select(*by, F.col("exec_on").alias("edge"))
    before = prefix.sums_before(weekly, asked, ["sku"], ["price_sum", "lines"])
    mean = F.nullif(F.try_divide("price_sum", "lines").cast("double"), F.lit(0.0))
    return asked.join(before, ["sku", "edge"], "left").select(*by, F.coalesce(mean, F.lit(1.0)).alias("base"))


def indexed_price_series(plans: DataFrame, invoices: DataFrame, spans: DataFrame) -> DataFrame:
    """Weekly price of a basket, each SKU over its own mean before execution, times the first SKU's base.

    ``plans``: (intervention_id, arm, skus, exec_on); ``spans``: (intervention_id, lo, hi), the weeks shown. Invoices, or
    their ``weekly_invoices``, are reduced to one row per SKU and week, and meet the distinct baskets on both; a plan is handed its basket's weeks at the end.
    """
    weekly = invoices.groupBy("sku", F.col("week").alias("date")).agg(
        F.sum("unit_price_cents").alias("price_sum"), _lines(invoices), F.sum("qty").alias("qty")
    )
    asks = plans.select(KEY, "arm", series_of("skus", "exec_on"), "skus", "exec_on")
    baskets = asks.select("series", "exec_on", "skus").distinct().select("series", "exec_on", F.posexplode("skus").alias("pos", "sku"))
    based = _basket_bases(baskets, weekly)
    per_week = based.join(weekly, "sku").groupBy("series", "date").agg(
        F.sum(F.col("price_sum") / F.col("base")).alias("_ratio"), F.sum("lines").alias("_lines"), F.sum("qty").alias("volume")
    )
    first = based.filter(F.col("pos") == 0).select("series", F.col("base").alias("_first"))
    points = per_week.join(first, "series").select("series", "date", (F.col("_ratio") / F.col("_lines") * F.col("_first")).alias("y"), "volume")
    return shown(asks.select(KEY, "arm", "series"), points.filter(F.col("date") == week_of("date")), spans).select(KEY, "arm", "date", "y", "volume")


def _frozen_prices(plans: DataFrame, by_sku: DataFrame, days: int) -> DataFrame:
    """Mean price of the days before execution; without a purchase in them the SKU's mean line price."""
    ask = plans.select("sku", "exec_on").distinct()
    at = ["sku", "exec_on"]
    asked = prefix.ends(ask, ["sku"], {"lo": F.date_sub("exec_on", days), "hi": F.col("exec_on")}, also=["exec_on"])
    sums = ["spent", "qty", "lines"]
    recent = prefix.between(asked, prefix.sums_before(by_sku, asked, ["sku"], sums), ["sku"], at, {"recent": ("lo", "hi")}, sums)
    ever = by_sku.groupBy("sku").agg(F.try_divide(F.sum("price_sum"), F.sum("lines")).cast("double").alias("_ever"))
    paid = F.when(F.col("lines_recent") > 0, F.try_divide(F.col("spent_recent"), F.nullif(F.col("qty_recent"), F.lit(0.0))))
    rows = ask.join(recent, at, "left").join(ever, "sku", "left")
    return rows.select(*at, F.coalesce(paid, F.nullif(F.col("_ever"), F.lit(0.0)), F.lit(1.0)).alias("frozen_price"))


def frozen_price_usage(plans: DataFrame, invoices: DataFrame, item_days: DataFrame, menu: DataFrame, spans: DataFrame, days: int = 28) -> DataFrame:
    """Weekly SKU quantity bought per plate sold, priced at the mean price of the days before execution.

    ``plans``: (intervention_id, arm, sign, sku, locs, exec_on), where the room ``*``
    stands for all rooms and a sign of -1 takes rooms out again; ``spans``: the weeks shown. The price is frozen
    over all rooms; without a purchase in those days the SKU's mean line price stands in. Plans that watch the same
    rooms and SKU share the weeks' usage, and those executed on one date its price.
    """
    weekly = invoices.groupBy("sku", "loc", F.col("week").alias("date")).agg(
        F.sum("qty").alias("qty"), F.sum("extended_cents").alias("spent"),
        F.sum("unit_price_cents").alias("price_sum"), _lines(invoices),
    )
    by_sku = weekly.groupBy("sku", "date").agg(*(F.sum(c).alias(c) for c in ("qty", "spent", "price_sum", "lines")))
    plates = weekly_plates(item_days, menu)
    facts = weekly.select("sku", "loc", "date", "qty", "lines", F.lit(0).cast("bigint").alias("plates")).unionByName(
        plates.select("sku", "loc", "date", F.lit(0.0).alias("qty"), F.lit(0).cast("bigint").alias("lines"), "plates")
    )
    everywhere = facts.groupBy("sku", "date").agg(*(F.sum(c).alias(c) for c in ("qty", "lines", "plates"))).withColumn("loc", F.lit("*"))
    # An arm's rooms: a handful of signed lists of them.
    asks = plans.groupBy(KEY, "arm", "sku", "exec_on").agg(F.array_sort(F.collect_set(F.struct("sign", F.array_sort("locs").alias("locs")))).alias("rooms")).withColumn("used", series_of("sku", "rooms"))
    rooms = asks.select("used", "sku", "rooms").distinct().select("used", "sku", F.inline("rooms")).select("used", "sku", "sign", F.explode("locs").alias("loc"))
    signed = lambda c: F.sum(F.col("sign") * F.col(c)).alias(c)
    usage = (
        rooms.join(facts.unionByName(everywhere), ["sku", "loc"])
        .filter(F.col("date") == week_of("date"))
        .groupBy("used", "date")
        .agg(signed("qty"), signed("lines"), signed("plates"))
        .filter((F.col("lines") > 0) & (F.col("plates") > 0))
    )
    priced = asks.select(KEY, "arm", "used", "sku", "exec_on", series_of("used", "exec_on"))
    prices = _frozen_prices(plans, by_sku, days)
    made = priced.select("series", "used", "sku", "exec_on").distinct().join(prices, ["sku", "exec_on"]).select("series", "used", "frozen_price")
    points = made.join(usage, "used").select("series", "date", (F.col("qty") * F.col("frozen_price") / F.col("plates")).alias("y"))
    return shown(priced.select(KEY, "arm", "series"), points, spans).select(KEY, "arm", "date", "y")
