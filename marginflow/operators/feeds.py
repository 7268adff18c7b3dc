"""Feed freshness and health, derived from what was delivered."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dims import BASELINE_DAYS_REQUIRED
from ..functions.dates import day
from ..session import attach


def feed_newest(as_of: Column, register_through: Column) -> Column:
    """Newest business date of a feed under its rule; a fixed date is never after ``as_of``."""
    rule = F.col("newest_rule")
    fixed = F.when(F.col("newest").isNotNull(), F.least("newest", as_of))
    return (
        F.when(rule == "pos", register_through)
        .when(rule == "today", as_of)
        .when(rule == "yesterday", F.date_sub(as_of, 1))
        .when(rule == "two_days", F.date_sub(as_of, 2))
        .when(rule == "none", F.lit(None).cast("date"))
        .otherwise(fixed)
    )


def feed_freshness(deliveries: dict[str, tuple[DataFrame, str | None]]) -> DataFrame:
    """Rows delivered and newest business date per feed; each source is reduced where it lies.

    ``deliveries``: feed code → (rows, name of the date column or None).
    """
    parts = []
    for code, (rows, date) in deliveries.items():
        newest = F.max(date) if date else F.lit(None).cast("date")
        parts.append(rows.agg(F.count(F.lit(1)).alias("rows"), newest.alias("newest")).select(F.lit(code).alias("code"), "rows", "newest"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def feed_health(feeds: DataFrame, as_of: str | dt.date) -> DataFrame:
    """Age in days, and whether it exceeds the feed's freshness rule; no rule or no date is never stale."""
    age = F.datediff(day(as_of), F.col("newest"))
    return feeds.withColumn("age_days", age).withColumn(
        "stale", F.coalesce((F.col("age_days") * 24) > F.col("sla_hours"), F.lit(False))
    )


def feed_lookup(feeds: DataFrame) -> DataFrame:
    """The feed catalogue as one row with one map.

    One entry per connected source system, so the row is small whatever the data;
    findings then need neither a join nor a shuffle to read their feeds.
    """
    has = set(feeds.columns)
    extra = lambda c, kind: (F.col(c) if c in has else F.lit(None)).cast(kind).alias(c)
    entry = F.struct(
        "code", F.struct(
            "completeness", "stale", extra("age_days", "int"), extra("sla_hours", "int"),
            F.coalesce(F.col("name") if "name" in has else F.lit(None).cast("string"), F.col("code")).alias("name"),
        ).alias("health"),
    )
    return feeds.agg(F.map_from_entries(F.collect_list(entry)).alias("feed_map"))


def with_feeds(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    return attach(rows, feed_lookup(feeds))


def baseline_status(orgs: DataFrame) -> DataFrame:
    """Days of register delivered against the days a baseline needs."""
    delivered = F.greatest(F.lit(0), F.coalesce(F.datediff("as_of", "connected_on"), F.lit(0)))
    return orgs.withColumn("delivered_days", delivered).withColumn("required_days", F.lit(BASELINE_DAYS_REQUIRED)).withColumn(
        "ready", F.col("delivered_days") >= BASELINE_DAYS_REQUIRED
    )
