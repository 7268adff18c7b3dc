"""Vocabularies, reserved words and registry references; ``contracts`` has the rules of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims


def check_enum(rows: DataFrame, column: str, vocabulary: DataFrame) -> DataFrame:
    """Values that a vocabulary table does not hold, with their counts."""
    return rows.join(vocabulary, column, "left_anti").groupBy(column).agg(F.count(F.lit(1)).alias("rows"))


def check_reserved_words(copy: DataFrame, text: str, klass: str | None = None) -> DataFrame:
    """Copy with a banned word, or with ``banked`` outside the realized class."""
    word = lambda words: F.col(text).rlike(r"(?i)\b(" + "|".join(words) + r")\b")
    banned = word(dims.BANNED_WORDS)
    banked = word(("banked",)) & (F.lit(True) if klass is None else F.coalesce(F.col(klass) != "realized", F.lit(True)))
    return copy.withColumn("problem", F.when(banned, "banned word").when(banked, "reserved word")).filter(F.col("problem").isNotNull())


def check_registry(findings: DataFrame) -> DataFrame:
    """Equations cited by findings that the registry does not hold."""
    spark = findings.sparkSession
    known = spark.createDataFrame([(k,) for k in dims.EQUATIONS], "equation string")
    cited = findings.select("id", F.explode("equations").alias("equation"))
    return cited.join(F.broadcast(known), "equation", "left_anti")
