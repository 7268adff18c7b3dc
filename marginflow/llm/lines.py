"""Line dedup: lines that many documents share stay in one of them only.

Lines are exploded under their normalised key (blanks stripped at both ends, A-Z lower-cased) and hashed; distinct
documents are counted per hash; a key of at least ``min_chars`` code points found in ``min_docs`` documents loses its
lines everywhere but in the largest doc_id holding it; what stays is joined again in its order.

Nulls: a null text is one empty line. A null doc_id counts as one document and is never the largest, unless all are
null; then all its lines stay. Rows that repeat a doc_id are one document in the counts and each keeps its own text.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import durable
from .common import BLANKS, ascii_lower, text_of, without

MIN_CHARS = 20
MIN_DOCS = 3


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def hashed(key: Column) -> Column:
    """96 bits of a line key."""
    return F.struct(F.xxhash64(key).alias("a"), F.hash(key).alias("b"))


def _lines() -> Column:
    return F.split(text_of(), "\n", -1)


def _row_id() -> Column:
    """A row's document: its doc_id, or for those without one its text."""
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


def shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """The exploded long lines (document, key) of every document, and the keys to thin with the document that keeps them.

    A document sends each key once. The distinct count shuffles by key and document first and by key after, each time
    after partial sums, so a line that a third of the documents hold does not meet in one task.
    """
    keys = F.filter(F.transform(_lines(), line_key), lambda k: F.length(k) >= min_chars)
    lines = docs.select(_row_id().alias("_id"), F.col("doc_id").isNull().alias("_none"), F.explode(F.array_distinct(F.transform(keys, hashed))).alias("key")).select("_id", "_none", "key.a", "key.b")
    named = F.when(~F.col("_none"), F.col("_id"))
    counts = lines.groupBy("a", "b").agg(F.count_distinct(named).alias("n"), F.max(F.col("_none").cast("int")).alias("none"), F.max(named).alias("owner"))
    return lines, durable(counts.where(F.col("n") + F.col("none") >= min_docs).select("a", "b", "owner"))


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Replaces text by what stays of it; adds n_lines and n_dropped."""
    docs = without(docs, "n_lines", "n_dropped")
    lines, shared = shared_lines(docs, min_chars, min_docs)
    # One row per document: its keys to drop, at most its own lines.
    drops = (
        lines.join(shared, ["a", "b"])
        .where(F.col("owner").isNotNull() & (F.col("_none") | (F.col("_id") != F.col("owner"))))
        .groupBy("_id", "_none")
        .agg(F.collect_set(F.col("a")).alias("_drop"))
    )
    kept = F.filter(_lines(), lambda x: (F.length(F.trim(x, F.lit(BLANKS))) < min_chars) | ~F.array_contains(F.col("_drop"), F.xxhash64(line_key(x))))
    out = docs.withColumn("_id", _row_id()).withColumn("_none", F.col("doc_id").isNull()).join(drops, ["_id", "_none"], "left").withColumn("_kept", F.when(F.col("_drop").isNull(), _lines()).otherwise(kept))
    return (
        out.withColumn("n_lines", F.size(_lines()).cast("long"))
        .withColumn("n_dropped", F.col("n_lines") - F.size("_kept"))
        .withColumn("text", F.array_join("_kept", "\n"))
        .drop("_id", "_none", "_drop", "_kept")
    )
