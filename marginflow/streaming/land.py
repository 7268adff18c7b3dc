"""Landing of arriving rows by key instead of by clock."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import keyed


def stream_land(rows: DataFrame, table: keyed.KeyedTable, checkpoint: str):
    """Starts landing what has arrived and stops when it is landed.

    A batch reads only the folders that its keys may be in, so its cost follows the batch: with a date among the
    partition columns, old dates are never looked at again. Of unequal rows of one key the table's order decides inside
    a batch, and the first landed one stays between batches. A repeated batch adds nothing.
    """
    return (
        rows.writeStream.foreachBatch(lambda batch, _id: keyed.land(batch.sparkSession, table, batch))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def stream_to_parquet(rows: DataFrame, path: str, checkpoint: str):
    """Appends finished rows of a streaming plan to Parquet."""
    return (
        rows.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
