"""Planted register: three rooms, two dayparts, 26 weeks, one step per detector.

Built from ranges and arithmetic only; a small repeating wobble stands in for noise.
"""

import datetime as dt

from pyspark.sql import functions as F

AS_OF = dt.date(2026, 9, 14)
START = AS_OF - dt.timedelta(days=182)


def wobble(*parts):
    """A deterministic value in [-1, 1] that looks irregular."""
    mixed = F.lit(0)
    for i, p in enumerate(parts):
        mixed = mixed + p * (7919 + 104729 * i)
    return ((mixed * 31 + mixed % 97 * 57) % 201 - 100) / 100.0


def grid(spark):
    days = spark.range(182).select(F.col("id").alias("d"))
    rooms = spark.createDataFrame([(0, "oak"), (1, "brk"), (2, "ala")], "room int, loc string")
    parts = spark.createDataFrame([(0, "lunch"), (1, "dinner")], "part int, daypart string")
    rows = days.join(rooms, F.lit(True)).join(parts, F.lit(True))
    date = F.date_add(F.lit(START), F.col("d").cast("int"))
    return rows.withColumn("date", date).withColumn("dow", F.dayofweek("date") - 1)


def services(spark):
    g = grid(spark)
    w = lambda n: wobble(F.col("d"), F.col("room"), F.col("part"), F.lit(n))
    covers = (F.lit(100) + F.col("dow") * 6 + 20 * w(1)).cast("bigint")
    gross = covers * 4000
    comp_step = F.when((F.col("loc") == "brk") & (F.col("daypart") == "dinner") & (F.col("d") >= 147), 0.02).otherwise(0.0)
    comps = (gross * (0.02 + 0.003 * w(2) + comp_step)).cast("bigint")
    slow = F.when((F.col("loc") == "ala") & (F.col("daypart") == "lunch") & (F.col("d") >= 133), 3.4).otherwise(0.0)
    return g.withColumn("covers", covers).withColumn("gross_cents", gross).withColumn("comps_cents", comps).select(
        "loc", "date", "dow", "daypart", "covers", F.lit(0).cast("bigint").alias("turned_away"), "gross_cents", "comps_cents",
        (F.col("gross_cents") - F.col("comps_cents")).alias("net_cents"), (F.col("gross_cents") * 0.3).cast("bigint").alias("cogs_cents"),
        (F.col("covers") * 900).cast("bigint").alias("labor_cents"), (F.col("covers") * 0.4).alias("hours"), (14 + 0.8 * w(3) + slow).alias("ticket_min"),
        (4.4 + 0.1 * w(4)).alias("rating"), F.lit(0.3).alias("constrained_share"), F.lit(False).alias("holiday"), F.lit(120).alias("capacity"),
    )


def role_shifts(spark):
    base = services(spark).join(grid(spark).select("loc", "date", "daypart", "d", "room", "part"), ["loc", "date", "daypart"])
    w = wobble(F.col("d"), F.col("room"), F.col("part"), F.lit(9))
    server = 10 + F.col("covers") * 0.22 + 0.4 * w
    extra = F.when((F.col("loc") == "oak") & (F.col("daypart") == "dinner") & (F.col("dow") == 2) & (F.col("d") >= 98), 9.0).otherwise(0.0)
    roles = F.array(
        F.struct(F.lit("server").alias("role"), server.alias("h"), F.lit(2400).cast("bigint").alias("r")),
        F.struct(F.lit("line").alias("role"), (F.lit(20.0) + extra).alias("h"), F.lit(2900).cast("bigint").alias("r")),
    )
    return base.select("loc", "date", "daypart", F.inline(roles)).select(
        "loc", "date", "daypart", "role", F.col("h").alias("scheduled_hours"), F.col("h").alias("clocked_hours"), F.col("r").alias("rate_cents")
    )


def menu(spark):
    rows = [("m1", "Chicken", 1000, "sk1", 0.5), ("m2", "Salad", 400, None, None), ("m3", "Burger", 900, None, None)]
    m = spark.createDataFrame(rows, "item string, name string, cost_cents bigint, uses_sku string, qty_per_unit double")
    history = F.array(F.struct(F.lit(START).alias("effective_on"), F.lit(2900).cast("bigint").alias("cents")))
    return m.withColumn("category", F.lit("Mains")).withColumn("price_history", history).select(
        "item", "name", "category", "cost_cents", "price_history", "uses_sku", "qty_per_unit"
    )


def item_days(spark):
    g = grid(spark)
    w = wobble(F.col("d"), F.col("room"), F.col("part"), F.lit(5))
    moved = (F.col("loc") == "ala") & (F.col("d") >= 126)
    units = F.array(
        F.struct(F.lit("m1").alias("item"), (40 + 4 * w - F.when(moved, 18).otherwise(0)).cast("bigint").alias("units"), F.lit(3200).cast("bigint").alias("price_cents"), F.lit(1000).cast("bigint").alias("cost_cents")),
        F.struct(F.lit("m2").alias("item"), (30 - 3 * w + F.when(moved, 18).otherwise(0)).cast("bigint").alias("units"), F.lit(1400).cast("bigint").alias("price_cents"), F.lit(400).cast("bigint").alias("cost_cents")),
        F.struct(F.lit("m3").alias("item"), (25 + 2 * w).cast("bigint").alias("units"), F.lit(2600).cast("bigint").alias("price_cents"), F.lit(900).cast("bigint").alias("cost_cents")),
    )
    return g.select("loc", "date", "daypart", F.inline(units))


def invoices(spark):
    weeks = spark.range(26).select(F.col("id").alias("w"))
    rooms = spark.createDataFrame([(0, "oak"), (1, "brk"), (2, "ala")], "room int, loc string")
    skus = spark.createDataFrame([(0, "sk1", "V1", 300), (1, "sk2", "V1", 500), (2, "sk3", "V2", 900)], "n int, sku string, vendor string, base int")
    rows = weeks.join(rooms, F.lit(True)).join(skus, F.lit(True))
    wob = wobble(F.col("w"), F.col("room"), F.col("n"))
    step = F.when((F.col("sku") == "sk1") & (F.col("w") >= 16), 1.141).otherwise(1.0)
    portion = F.when((F.col("sku") == "sk1") & (F.col("loc") == "oak") & (F.col("w") >= 17), 1.235).otherwise(1.0)
    price = (F.col("base") * step * (1 + 0.004 * wob)).cast("bigint")
    sold = F.when(F.col("sku") == "sk1", 280.0).otherwise(60.0)
    qty = sold * (1 + 0.01 * wob) * portion
    monday = F.date_add(F.trunc(F.lit(START), "week"), (F.col("w") * 7 + 7).cast("int"))
    return rows.withColumn("unit_price_cents", price).withColumn("qty", qty).select(
        "loc", monday.alias("week"), "sku", "vendor", "unit_price_cents", "qty", (F.col("unit_price_cents") * F.col("qty")).cast("bigint").alias("extended_cents")
    )


def skus(spark):
    return spark.createDataFrame([("sk1", "Chicken thigh", "V1", "lb"), ("sk2", "Butter", "V1", "lb"), ("sk3", "Salmon", "V2", "lb")], "sku string, name string, vendor string, unit string")


def dayparts(spark):
    return spark.createDataFrame([("lunch", "Lunch", 11, 15, 4.0), ("dinner", "Dinner", 17, 22, 5.0)], "daypart string, label string, start_hour int, end_hour int, hours double")


def locations(spark):
    return spark.createDataFrame([("oak", "Oak", "Oak", 100, START), ("brk", "Brk", "Brk", 100, START), ("ala", "Ala", "Ala", 100, START)], "loc string, name string, short string, seats int, opened date")


def roles(spark):
    return spark.createDataFrame([("server", "Server", True, 2400), ("line", "Line", False, 2900)], "role string, label string, foh boolean, loaded_rate_cents bigint")


def reservation_days(spark):
    return services(spark).select("loc", "date", "daypart", F.col("covers").alias("booked"), F.lit(0).cast("bigint").alias("walk_in"), F.lit(10.0).alias("quoted_wait_min"), F.lit(0).cast("bigint").alias("abandoned"))


def feed_rows(spark):
    rows = [
        ("toast_orders", "Orders", "Pilot", 36, 0.99, 70000, None, "pos"), ("toast_labour", "Labour", "Pilot", 36, 0.98, 22000, None, "yesterday"),
        ("scheduling", "Scheduling", "Next", 36, 0.97, 22000, None, "yesterday"), ("recipes", "Recipes", "Pilot", 168, 0.97, 54, AS_OF - dt.timedelta(days=3), "fixed"),
        ("invoices", "Invoices", "Next", 336, 0.96, 1900, None, "two_days"), ("kds", "KDS", "Next", 48, 0.95, 90000, None, "pos"),
        ("reservations", "Reservations", "Next", 24, 0.93, 2200, AS_OF - dt.timedelta(days=9), "fixed"),
    ]
    return spark.createDataFrame(rows, "code string, name string, tier string, sla_hours int, completeness double, rows bigint, newest date, newest_rule string")


def declarations(spark):
    """One comps change that worked, one without effect, one still open."""
    rows = [
        ("IV-01", "F-1", "comps", "comps_per_cover", "cover", "down_is_saving", "did", True, "oak", "lunch", AS_OF - dt.timedelta(days=90), "complete", 5000, 800000),
        ("IV-02", "F-2", "mix_shift", "cm_per_cover", "cover", "up_is_saving", "did", True, "brk", None, AS_OF - dt.timedelta(days=70), "complete", 0, 1),
        ("IV-03", "F-3", "comps", "comps_per_cover", "cover", "down_is_saving", "did", True, "ala", "lunch", AS_OF - dt.timedelta(days=10), "complete", 0, 20000),
    ]
    d = spark.createDataFrame(
        rows, "intervention_id string, finding_id string, lever string, metric string, grain string, direction string, estimator string, weekly boolean, loc string, daypart string, exec_on date, fidelity string, incremental_cost_cents bigint, projected_cents bigint"
    )
    one = lambda c: F.when(F.col(c).isNotNull(), F.array(c))
    none = lambda kind: F.lit(None).cast(kind)
    return d.select(
        "*", F.array("loc").alias("locs"), F.array("loc").alias("treat_locs"), one("daypart").alias("treat_dayparts"), none("array<int>").alias("treat_dows"),
        F.lit(True).alias("control_others"), none("array<string>").alias("control_locs"), one("daypart").alias("control_dayparts"), none("array<int>").alias("control_dows"),
        none("string").alias("treat_sku"), none("array<string>").alias("control_skus"), none("array<string>").alias("treat_items"), none("array<string>").alias("control_items"),
        F.date_sub("exec_on", 10).alias("decided_on"), F.lit(56).alias("baseline_days"), F.lit(28).alias("window_days"), F.lit(7).alias("latency_days"), F.lit(4).alias("min_obs"),
        F.lit(4).alias("preferred_obs"), F.lit(2).alias("rung"), F.lit(0).cast("bigint").alias("recurring_cost_cents"), F.lit(0).cast("bigint").alias("overlap_cents"),
        F.lit("none").alias("overlap_status"), F.array(F.lit("covers"), F.lit("rating")).alias("guardrails"), none("date").alias("reversal_on"),
    )
