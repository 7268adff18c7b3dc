"""Registration of queries and of the SQL each is checked against."""

from __future__ import annotations

from collections import ChainMap
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .oracle_views import ORACLE_VIEWS
from .views import VIEWS, Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
CATALOGUE = ChainMap(VIEWS, ORACLE_VIEWS)


def query(name: str, sql: str | None = None):
    def register(build: Callable[[Inputs], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql, CATALOGUE)
        return build

    return register


# Means of 2^m integers end exactly on a rounding boundary; the nudge moves the boundary off them.
HALF = 0.50137


def r(x: Column | str, digits: int = 6) -> Column:
    """Round late and alike in both engines."""
    c = F.col(x) if isinstance(x, str) else x
    scale = float(10**digits)
    return F.floor(c.cast("double") * scale + HALF) / scale


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, dates as text, integers as bigint, for the value check."""
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = r(c, digits)
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), "+")
        out.append(c.alias(f.name))
    return df.select(*out)


def tidy_sql(body: str, digits: int = 6, **kinds: str) -> str:
    """The same for SQL: columns named per kind (``doubles="a b"``, ``dates=…``, ``ints=…``, ``keep=…``)."""
    scale = 10**digits
    cols = []
    for c in kinds.get("keep", "").split():
        cols.append(c)
    for c in kinds.get("ints", "").split():
        cols.append(f"CAST({c} AS BIGINT) AS {c}")
    for c in kinds.get("doubles", "").split():
        cols.append(f"floor(CAST({c} AS DOUBLE) * {scale} + {HALF}) / {scale} AS {c}")
    for c in kinds.get("dates", "").split():
        cols.append(f"strftime({c}, '%Y-%m-%d') AS {c}")
    return f"SELECT {', '.join(cols)} FROM (\n{body}\n)"
