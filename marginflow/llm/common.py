"""Helpers that several corpus operators share."""

from __future__ import annotations

import string
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..session import durable, scratch_dir

#: A word is a run of anything but the six ASCII blanks.
BLANK = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"
#: A group's rows are dealt to so many slices by hash, so that no task holds a hot group.
SLICES = 4096
#: Rows of a table that may be broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 50_000
#: Rows of a narrow table that one task writes.
FILE_ROWS = 100_000


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; texts without other letters take the faster built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also inside array functions, which would repeat an expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def staged(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Cuts lineage with a compressed table in the shared folder; for tables too wide for ``durable``.

    A table that holds at most ``rows`` rows is written by as many tasks as they need, not by one per shuffle partition.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/staged-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(max(1, -(-rows // FILE_ROWS)))).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def join_sized(rows: DataFrame, side: DataFrame, on: Sequence[str], how: str = "inner", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a durable side table: by broadcast if it has ``most`` rows or fewer, else by a shuffle that AQE may split."""
    small = side.limit(most + 1).count() <= most
    return rows.join(F.broadcast(side) if small else side, list(on), how)


def without(df: DataFrame, *results: str) -> DataFrame:
    """Input columns named like a result, or with a leading underscore, give way to the operator's own."""
    return df.drop(*(c for c in df.columns if c in results or c.startswith("_")))


def group_key(name: str) -> Column:
    """A key that is never null: null forms a group of its own."""
    return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("null"))


def row_hash(df: DataFrame) -> Column:
    """A hash of all that a row holds, but for columns that cannot be compared."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))))


def shuffle_key(df: DataFrame, seed: str, *ids: str) -> Column:
    """A hex hash of the ids: the order of a seeded shuffle, the same in every run and engine.

    Rows without an id are shuffled by all that they hold, so that they are spread like others; equal ones tie.
    """
    row = F.concat(F.lit("null "), row_hash(df).cast("string"))
    return F.md5(F.concat_ws(":", F.lit(seed), *(F.coalesce(F.col(c).cast("string"), row) for c in ids)))


def sliced(df: DataFrame, group: str, ids: Sequence[str], seed: str) -> DataFrame:
    """Adds ``_g`` (the group), ``_h`` (its shuffle order) and ``_slice`` (the leading 12 bits of that order)."""
    return df.withColumn("_g", group_key(group)).withColumn("_h", shuffle_key(df, seed, *ids)).withColumn("_slice", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))


def slice_totals(rows: DataFrame, group: str, **sums: Column) -> DataFrame:
    """One row per group and slice with its sums; at most ``SLICES`` rows per group, combined before the shuffle."""
    return durable(rows.groupBy("_g", "_slice").agg(F.first(group).alias("_name"), *(F.sum(c).alias(k) for k, c in sums.items())))


def before_slice(totals: DataFrame, name: str) -> Column:
    """What a group's earlier slices hold of ``name``."""
    w = W.partitionBy("_g").orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(w), F.lit(0))


def in_slice(ties: Sequence[str | Column]):
    """The shuffle order inside a slice. Equal rows that tie in every id are interchangeable."""
    return W.partitionBy("_g", "_slice").orderBy("_h", *ties)
