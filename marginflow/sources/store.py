"""Record tables: append-only logs, partition replacement and listings; ``keyed`` has the upserts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable


def read_records(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """A record table, empty if it was never written."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def replace_partition(rows: DataFrame, path: str, partition: Sequence[str] = ("org_id",)) -> None:
    """Overwrites only the partitions present in the rows.

    The rows may come from the table itself, so they are made durable first; the
    old files go only when the new ones are committed.
    """
    durable(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition).parquet(path)


def replace_tenant(rows: DataFrame, path: str, org_id: str) -> None:
    """Overwrites the partition of one tenant, also with no rows at all: what it held before is gone."""
    durable(rows.where(F.col("org_id") == org_id)).drop("org_id").write.mode("overwrite").parquet(f"{path}/org_id={org_id}")


def append_log(rows: DataFrame, path: str, partition: Sequence[str] = ("org_id",)) -> None:
    """Append-only: verdicts, audit events and runs are never rewritten."""
    rows.write.mode("append").partitionBy(*partition).parquet(path)


def append_once(rows: DataFrame, logged: DataFrame, path: str, keys: Sequence[str], partition: Sequence[str] = ("org_id",)) -> None:
    """Appends the rows whose keys, nulls included, are not in ``logged`` yet: what a run wrote before it died is not written again."""
    old = logged.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
    append_log(rows.join(old, same, "left_anti"), path, partition)


def list_findings(findings: DataFrame, state: str | None = None, historical: bool | None = None, limit: int | None = None) -> DataFrame:
    """Findings by recoverable cents, largest first."""
    rows = findings
    if state is not None:
        rows = rows.filter(F.col("state") == state)
    if historical is not None:
        rows = rows.filter(F.col("historical") == historical)
    rows = rows.orderBy(F.col("recoverable_cents").desc(), "id")
    return rows if limit is None else rows.limit(limit)


def list_audit(events: DataFrame, entity_kind: str | None = None, entity_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Audit events by date, then step; all of them unless a limit is asked for."""
    rows = events
    if entity_kind is not None:
        rows = rows.filter(F.col("entity_kind") == entity_kind)
    if entity_id is not None:
        rows = rows.filter(F.col("entity_id") == entity_id)
    ordered = rows.orderBy("on_date", "entity_id", "event")
    return ordered if limit is None else ordered.limit(limit)


def list_runs(runs: DataFrame, limit: int | None = None) -> DataFrame:
    ordered = runs.orderBy(F.col("as_of").desc())
    return ordered if limit is None else ordered.limit(limit)


def record_counts(findings: DataFrame, interventions: DataFrame) -> DataFrame:
    """Findings and interventions per tenant."""
    a = findings.groupBy("org_id").agg(F.count(F.lit(1)).alias("findings"))
    b = interventions.groupBy("org_id").agg(F.count(F.lit(1)).alias("interventions"))
    return a.join(b, "org_id", "full_outer").fillna(0)
