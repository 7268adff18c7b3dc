"""Session set-up, durable lineage cuts and distributed row numbering."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def local_session(cpus: int | str = 8, app: str = "marginflow", shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and staged tables, as the cluster names it in ``spark.checkpoint.dir``.

    A session on one machine (master ``local[...]``), where driver and executors are the same process, may go
    without the setting and gets a folder that ends with the process. Any other session without it is refused.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder is None:
        if not re.fullmatch(r"local(\[[^]]*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="marginflow-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def durable(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared checkpoint folder, so the result survives lost executors."""
    scratch_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder: each reader takes only the columns that it needs."""
    path = f"{scratch_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def attach(rows: DataFrame, single: DataFrame) -> DataFrame:
    """Adds the columns of a one-row aggregate to every row, as a scalar subquery instead of a join."""
    value = single.select(F.struct(*single.columns).alias("_row")).scalar()
    return rows.withColumn("_row", value).select(*(F.col(f"`{c}`") for c in rows.columns), "_row.*")


def number_rows(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """Global 1-based position under ``order``, without a single-task window.

    A range-partitioned sort is made durable, the partitions are counted, and
    each row adds its partition's offset to its position inside the partition.
    The offsets table has one row per partition.
    """
    ordered = durable(df.orderBy(*order))
    located = ordered.withColumn("_pid", F.spark_partition_id()).withColumn(
        "_pos", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    )
    counts = located.groupBy("_pid").agg(F.count(F.lit(1)).alias("_rows"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    return (
        located.join(F.broadcast(offsets), "_pid")
        .withColumn(name, F.col("_offset") + F.col("_pos") + 1)
        .drop("_pid", "_pos", "_offset")
    )


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """1-based rank inside a group of any size: the group is never held by one task.

    Ranks come from the global position minus the group's first position.
    """
    numbered = number_rows(df, [*(F.col(c) for c in group), *order], "_at")
    first = numbered.groupBy(*group).agg(F.min("_at").alias("_first"))
    return numbered.join(first, list(group)).withColumn(name, F.col("_at") - F.col("_first") + 1).drop("_at", "_first")
