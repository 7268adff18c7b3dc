"""Shards that all match the mixture: proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked inside their source; a row's fractional rank is its place between 0 and
1 in that source. Sorted by fractional rank, every stretch of rows holds the sources in proportion, so cutting the
order into equal stretches gives shards whose counts differ by one at most (law ``rows``) and whose mixtures agree.

Equal texts are not kept together: only counts and mixture are promised. Nulls: a null source is a stratum of its own;
a null text has no bytes; rows with a null doc_id are shuffled by all that they hold. Repeated rows are separate rows, in either order.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import number_rows
from .common import before_slice, in_slice, join_sized, row_hash, slice_totals, sliced, without

SEED = "shard-1"
SHARDS = 8


def shard(docs: DataFrame, shards: int = SHARDS, seed: str = SEED) -> DataFrame:
    """Adds shard and slot (gapless from 0 in each shard).

    Ranks need one shuffle by source and hash slice; the global order is a range sort with offsets per partition.
    Neither holds a source in one task.
    """
    docs = without(docs, "shard", "slot")
    rows = sliced(docs, "source", ["doc_id"], seed)
    tie = row_hash(docs)
    totals = slice_totals(rows, "source", n=F.lit(1))
    sizes = totals.groupBy("_g").agg(F.sum("n").alias("_n"))
    slices = join_sized(totals.select("_g", "_slice", before_slice(totals, "n").alias("_before")), sizes, ["_g"])
    ranked = rows.withColumn("_in", F.row_number().over(in_slice(["doc_id", tie]))).join(slices, ["_g", "_slice"])
    placed = ranked.withColumn("_part", (2 * (F.col("_before") + F.col("_in")) - 1) / (2 * F.col("_n")))
    numbered = number_rows(placed, [F.col("_part"), F.col("_g"), F.col("_h")], "_at")
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    at = F.col("_at") - 1
    # A shard's first row is the first whose position times the shard count reaches the shard number times the total.
    chosen = numbered.withColumn("shard", F.floor(at * shards / F.lit(total)).cast("int")) if total else numbered.withColumn("shard", F.lit(0))
    first = F.ceil(F.col("shard").cast("long") * F.lit(total) / shards)
    return chosen.withColumn("slot", (at - first).cast("long")).drop("_g", "_h", "_slice", "_in", "_before", "_n", "_part", "_at")
