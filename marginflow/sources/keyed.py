"""Record tables laid out by key: a change reads and rewrites only the buckets its keys fall into.

A table is partitioned by its own partition columns (a tenant, a week) and by a hash bucket of its key. What a batch may
hit is known from the batch alone, as a handful of partition values, so the scan of what is stored is pruned to those
folders and the write replaces only them; the rest of the table is neither listed file by file nor touched. The number
of buckets belongs to the table and is chosen for its final size, so that a bucket stays one task's work.

Of several rows of one key in a batch the greatest by the given order wins, ties by a hash of the whole row, the same in
every run. Nulls in keys are equal to each other. A repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import durable
from .store import read_records

BUCKET = "bucket"


@dataclass(frozen=True)
class KeyedTable:
    """Where a table is and how it is laid out. ``schema``: DDL of its columns, the partition columns among them."""

    path: str
    schema: str
    keys: tuple[str, ...]
    partition: tuple[str, ...] = ()
    buckets: int = 64
    order: tuple[str, ...] = ()

    @property
    def columns(self) -> list[str]:
        return T._parse_datatype_string(self.schema).names

    @property
    def folders(self) -> list[str]:
        return [*self.partition, BUCKET]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def stored(self, spark: SparkSession) -> DataFrame:
        return read_records(spark, self.path, f"{self.schema}, {BUCKET} int")

    def read(self, spark: SparkSession) -> DataFrame:
        return self.stored(spark).select(self.columns)


def latest(rows: DataFrame, table: KeyedTable) -> DataFrame:
    """One row per partition and key: the greatest by the table's order, then by hash."""
    whole = F.struct(*(F.col(c).alias(c) for c in table.columns))
    rank = F.struct(*(F.col(c).alias(f"o{k}") for k, c in enumerate(table.order)), F.xxhash64(*table.columns).alias("h"))
    best = rows.groupBy(*table.partition, *table.keys).agg(F.max_by(whole, rank).alias("_row"))
    return best.select("_row.*")


def _same(table: KeyedTable) -> Column:
    out = F.lit(True)
    for c in (*table.partition, *table.keys):
        out = out & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return out


def reached(spark: SparkSession, table: KeyedTable, rows: DataFrame) -> DataFrame:
    """The stored rows of the folders that ``rows`` may hit, as a scan pruned by partition values."""
    # One row per folder of the batch: at most the buckets of the partitions it names.
    hit = rows.select(*table.partition, table.bucket().alias(BUCKET)).distinct().collect()
    test = F.lit(False)
    by_partition: dict[tuple, list[int]] = {}
    for r in hit:
        by_partition.setdefault(tuple(r)[:-1], []).append(r[BUCKET])
    for values, buckets in by_partition.items():
        own = F.col(BUCKET).isin(buckets)
        for c, v in zip(table.partition, values):
            own = own & (F.col(c).isNull() if v is None else F.col(c) == F.lit(v))
        test = test | own
    return table.stored(spark).filter(test)


def _write(rows: DataFrame, table: KeyedTable, mode: str) -> None:
    placed = rows.withColumn(BUCKET, table.bucket()).hint("rebalance", *table.folders)
    placed.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*table.folders).parquet(table.path)


def upsert(spark: SparkSession, table: KeyedTable, updates: DataFrame) -> DataFrame:
    """Puts the updates in by key and returns the changes: the stored rows that went (``weight`` -1) and the new ones (1).

    Only folders with a changed row are rewritten; an update equal to what is stored is no change.
    """
    fresh = durable(latest(updates.select(table.columns), table))
    old = durable(reached(spark, table, fresh))
    different = F.lit(False)
    for c in table.columns:
        different = different | ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    new = durable(fresh.alias("a").join(old.alias("b"), _same(table), "left").filter(F.col(f"b.{BUCKET}").isNull() | different).select("a.*"))
    gone = old.alias("a").join(new.alias("b"), _same(table), "left_semi").select(table.columns)
    dirty = new.select(*table.partition, table.bucket().alias(BUCKET)).distinct()
    here = F.col(f"a.{BUCKET}") == F.col(f"b.{BUCKET}")
    for c in table.partition:
        here = here & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    kept = old.alias("a").join(dirty.alias("b"), here, "left_semi").alias("a").join(new.alias("b"), _same(table), "left_anti").select(table.columns)
    changes = durable(new.withColumn("weight", F.lit(1)).unionByName(gone.withColumn("weight", F.lit(-1))))
    _write(durable(kept.unionByName(new)), table, "overwrite")
    return changes


def land(spark: SparkSession, table: KeyedTable, batch: DataFrame) -> DataFrame:
    """Appends the rows whose keys are not stored yet and returns them; what is stored is never rewritten."""
    one = durable(latest(batch.select(table.columns), table))
    stored = reached(spark, table, one).select(*table.partition, *table.keys)
    fresh = durable(one.alias("a").join(stored.alias("b"), _same(table), "left_anti").select(table.columns))
    _write(fresh, table, "append")
    return fresh


def restate(spark: SparkSession, table: KeyedTable, updates: DataFrame, restated: Sequence[str] = ("cents", "status")) -> DataFrame:
    """Adds new records; of a known one only the ``restated`` columns change, its identity stays. Returns the changes."""
    fresh = latest(updates.select(table.columns), table)
    old = reached(spark, table, durable(fresh))
    met = fresh.alias("a").join(old.alias("b"), _same(table), "left")
    known = F.col(f"b.{BUCKET}").isNotNull()
    kept = [F.when(known & F.lit(c not in restated), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in table.columns]
    return upsert(spark, table, met.select(*kept))
