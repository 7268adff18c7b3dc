"""Parquet register: reading by tenant and landing increments."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import to_date, week_of
from ..schemas import REGISTER_TABLES, ddl
from ..session import attach, durable
from .store import read_records

# Fact tables and their date column; they are laid out by tenant and week.
FACTS = {"services": "date", "item_days": "date", "shifts": "date", "invoices": "week", "reservation_days": "date"}


def table_schema(name: str) -> str:
    """Stored layout: the contract columns, the partition week of facts, and the tenant."""
    cols = dict(REGISTER_TABLES[name])
    if name in FACTS:
        cols["week"] = "date"
    return ddl({**cols, "org_id": "string"})


def load_table(spark: SparkSession, path: str, name: str, org: str, since: dt.date | str | None = None) -> DataFrame:
    """One register table of one tenant; of facts only the rows from ``since`` on.

    The tenant and the Monday of ``since`` are partition filters, so older weeks are not even listed; the date itself
    and any later filter go down to the files.
    """
    rows = spark.read.schema(table_schema(name)).parquet(f"{path}/{name}").filter(F.col("org_id") == org)
    if since is not None and name in FACTS:
        first = to_date(since)
        rows = rows.filter((F.col("week") >= F.lit(first - dt.timedelta(days=first.weekday()))) & (F.col(FACTS[name]) >= F.lit(first)))
    return rows.select(*REGISTER_TABLES[name])


def load_register(spark: SparkSession, path: str, org: str, since: dict[str, dt.date | None] | None = None) -> dict[str, DataFrame]:
    """All ten register tables of a tenant; ``since``: the first day that is needed of a fact table."""
    return {name: load_table(spark, path, name, org, (since or {}).get(name)) for name in REGISTER_TABLES}


def increment(rows: DataFrame, date_column: str, after: dt.date | str | None) -> DataFrame:
    """Rows past the high-water mark; all of them when nothing was landed yet."""
    return rows if after is None else rows.filter(F.col(date_column) > F.lit(to_date(after)))


def landed_marks(spark: SparkSession, path: str, org: str) -> dict[str, dt.date | None]:
    """The newest date that each fact table holds; one row per table comes to the driver.

    Each table has a mark of its own, so a landing that died between two tables goes on where each of them stopped.
    """
    parts = []
    for name, column in FACTS.items():
        stored = read_records(spark, f"{path}/{name}", table_schema(name)).filter(F.col("org_id") == org)
        parts.append(stored.agg(F.max(column).alias("mark")).select(F.lit(name).alias("table"), "mark"))
    return {r["table"]: r["mark"] for r in reduce(DataFrame.unionByName, parts).collect()}


def land_increment(tables: dict[str, DataFrame], path: str, org: str, marks: dict[str, dt.date | None] | None = None) -> None:
    """Appends the facts past each table's mark, partitioned by tenant and week. Landing the same rows twice adds nothing.

    Rows are rebalanced by partition, so a task opens few files and AQE splits a large week.
    """
    for name, rows in tables.items():
        column = FACTS[name]
        fresh = increment(rows, column, (marks or {}).get(name)).withColumn("org_id", F.lit(org))
        if name != "invoices":
            fresh = fresh.withColumn("week", week_of("date"))
        fresh.hint("rebalance", "org_id", "week").write.mode("append").partitionBy("org_id", "week").parquet(f"{path}/{name}")


def land_tenants(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> None:
    """Appends the facts of all tenants past the mark of each, in one pass per table.

    ``tables``: facts with their ``org_id``. Marks stay a table, one row per tenant that has any, and meet the rows by
    tenant; a tenant without one lands all of its rows. Landing the same delivery twice adds nothing.
    """
    for name, rows in tables.items():
        column = FACTS[name]
        stored = read_records(spark, f"{path}/{name}", table_schema(name))
        marks = durable(stored.groupBy("org_id").agg(F.max(column).alias("_mark")))
        fresh = rows.join(marks, "org_id", "left").filter(F.col("_mark").isNull() | (F.col(column) > F.col("_mark"))).drop("_mark")
        if name != "invoices":
            fresh = fresh.withColumn("week", week_of("date"))
        fresh.hint("rebalance", "org_id", "week").write.mode("append").partitionBy("org_id", "week").parquet(f"{path}/{name}")


def write_dimension(rows: DataFrame, path: str, name: str, org: str) -> None:
    """Replaces one tenant's rows of a dimension and leaves the other tenants' alone."""
    (
        rows.withColumn("org_id", F.lit(org)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("org_id").parquet(f"{path}/{name}")
    )


def high_water_marks(services: DataFrame, invoices: DataFrame, after: dt.date | str) -> DataFrame:
    """Newest service date, newest invoice week and the services past a date, in one row."""
    a = services.agg(F.max("date").alias("last_date"), F.count(F.when(F.col("date") > F.lit(to_date(after)), 1)).alias("services_after"))
    b = invoices.agg(F.max("week").alias("last_week"))
    return attach(a, b)
