"""Array, map and JSON helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def finite(x: Column) -> Column:
    """Infinite and undefined numbers become null, as JSON has no form for them."""
    return F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(None).cast("double")).otherwise(x)


def to_document(df: DataFrame, keep: list[str], name: str = "record") -> DataFrame:
    """The listed columns stay flat; the whole row goes beside them as JSON."""
    fields = [
        finite(F.col(f.name)).alias(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*keep, F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias(name))


def from_document(df: DataFrame, schema: T.StructType, name: str = "record") -> DataFrame:
    return df.select(F.from_json(F.col(name), schema).alias("_r")).select("_r.*")
