"""Incremental roll-up of arriving rows to service grain, all measures."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rollup
from ..operators.rollup import KEY
from ..sources.store import read_records

#: What a service adds up from arriving rows. Every part is a sum of weights or of weighted values, so a row that is taken
#: back (weight -1) leaves no trace; a booking is told by its id, of which the last that still stands counts.
PARTS = {
    "anchors": "bigint", "guests": "bigint", "comps": "bigint", "subtotal": "bigint", "cost": "bigint", "wages": "double", "clocked": "double", "ticket_sum": "double",
    "tickets": "bigint", "rating_sum": "double", "ratings": "bigint", "booked": "bigint",
}
BOOKING = {"booking": "bigint", "turned_away": "bigint", "constrained_share": "double", "holiday": "boolean", "capacity": "int"}
ARRIVING = "loc string, date date, daypart string, weight int, " + ", ".join(f"{c} {t}" for c, t in {**PARTS, **BOOKING}.items())
STORED = ARRIVING.replace(" weight int,", "")
SPAN = ("first_batch", "last_batch")


def _arriving(rows: DataFrame, **given) -> DataFrame:
    weight = F.col("weight") if "weight" in rows.columns else F.lit(1)
    values = [given.get(c, F.lit(None)).cast(t).alias(c) for c, t in {**PARTS, **BOOKING}.items()]
    return rows.select("loc", F.col("business_date").alias("date"), "daypart", weight.cast("int").alias("weight"), *values)


#: How each source's rows count. A column ``weight`` of -1 takes a row back, as a correction of it does.
SOURCES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "checks": lambda d: _arriving(d.filter(~F.col("voided")), anchors=F.lit(1), guests=F.col("guest_count"), comps=F.col("comp_cents"), subtotal=F.col("subtotal_cents")),
    "order_items": lambda d: _arriving(d, cost=F.col("qty") * F.col("unit_cost_cents"), ticket_sum=F.col("ticket_min"), tickets=F.col("ticket_min").isNotNull().cast("int")),
    "shifts": lambda d: _arriving(d, anchors=F.lit(1), wages=F.col("clocked_hours") * F.col("wage_rate_cents"), clocked=F.col("clocked_hours")),
    "reviews": lambda d: _arriving(d, rating_sum=F.col("rating"), ratings=F.col("rating").isNotNull().cast("int")),
    "reservations": lambda d: _arriving(d, anchors=F.lit(1), booked=F.lit(1), booking=F.col("id"), **{c: F.col(c) for c in BOOKING if c != "booking"}),
}


def arriving(**sources: DataFrame) -> DataFrame:
    """The rows of all five sources, streamed or not, in one narrow layout."""
    return reduce(DataFrame.unionByName, (SOURCES[name](rows) for name, rows in sources.items()))


def _added(rows: DataFrame, weighted: bool) -> DataFrame:
    w = F.col("weight") if weighted else F.lit(1)
    sums = rows.groupBy(*KEY, *BOOKING).agg(*(F.sum(F.col(c) * w).alias(c) for c in PARTS))
    return sums.select(*KEY, *PARTS, *BOOKING)


def stream_service_rollup(rows: DataFrame, path: str, checkpoint: str):
    """Starts adding up the ``arriving`` rows, for ``service_rollup``, and stops when what has arrived is added.

    Each batch leaves its sums per service (and booking) in a folder of its own, which a repeated batch writes anew.
    There is no watermark: open days are there at once, and a row or a correction counts however late it comes.
    """

    def add(batch: DataFrame, n: int) -> None:
        _added(batch, weighted=True).write.mode("overwrite").parquet(f"{path}/first_batch={n}/last_batch={n}")

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _sums(spark: SparkSession, path: str) -> DataFrame:
    """The stored sums; folders whose batches lie in a wider folder are left out by their partition values."""
    stored = read_records(spark, path, f"{STORED}, first_batch bigint, last_batch bigint")
    # One row per folder: as many as batches since the last compaction, at least.
    spans = sorted((r[0], -r[1]) for r in stored.select(*SPAN).distinct().collect())
    test, reach = F.lit(False), -1
    for first, last in ((a, -b) for a, b in spans):
        if last > reach:
            test, reach = test | ((F.col("first_batch") == first) & (F.col("last_batch") == last)), last
    return stored.filter(test)


def compact(spark: SparkSession, path: str) -> None:
    """Adds the folders of all batches so far into one, which stands for them from then on.

    The wide folder counts once it is committed; its parts are left out by readers and can be deleted.
    """
    sums = _sums(spark, path)
    first, last = sums.agg(F.min("first_batch"), F.max("last_batch")).first()
    if first is not None and first < last:
        _added(sums, weighted=False).write.mode("overwrite").parquet(f"{path}/first_batch={first}/last_batch={last}")


def service_rollup(spark: SparkSession, path: str) -> DataFrame:
    """The services of all batches so far, as ``operators.rollup.rollup_services`` makes them from all rows at once."""
    sums = _added(_sums(spark, path), weighted=False)
    standing = F.when(F.col("booked") > 0, F.col("booking"))
    last = lambda c: F.max_by(c, standing)
    total = sums.groupBy(*KEY).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in PARTS), *(last(c).alias(c) for c in BOOKING))
    services = total.filter(F.col("anchors") > 0).select(
        *KEY, F.col("guests").alias("covers"), F.coalesce("turned_away", F.lit(0)).alias("turned_away"), F.col("comps").alias("comps_cents"), F.col("subtotal").alias("net_cents"),
        F.col("cost").alias("cogs_cents"), rollup.round_cents(F.col("wages")).alias("labor_cents"), rollup.round_quarter(F.col("clocked")).alias("hours"),
        F.coalesce(rollup.round_to(F.try_divide("ticket_sum", "tickets"), 1), F.lit(0.0)).alias("ticket_min"),
        rollup.round_to(F.try_divide("rating_sum", "ratings"), 2).alias("rating"), F.coalesce("constrained_share", F.lit(0.0)).alias("constrained_share"),
        F.coalesce("holiday", F.lit(False)).alias("holiday"), F.coalesce("capacity", F.lit(0)).alias("capacity"),
    )
    return rollup.as_services(services)
