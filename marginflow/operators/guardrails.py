"""What must not get worse, over the same window as the primary effect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from .measure import KEY, estimate


def run_guardrails(plans: DataFrame, service_moments: DataFrame) -> DataFrame:
    """One row per (intervention, guardrail), from the cell moments of the guardrails' series.

    A breach needs the optimistic end of the interval past the tolerance; a
    guardrail that is unknown or could not be observed has failed.
    """
    spark = plans.sparkSession
    controlled = F.coalesce("control_others", F.lit(False)) | F.col("control_locs").isNotNull()
    meta = plans.withColumn("controlled", controlled)
    moments = service_moments.filter(F.col("series").startswith("g_") & (F.col("_seen") > 0)).withColumn("guardrail", F.expr("substr(series, 3)")).drop("series", "_seen")
    est = estimate(moments.join(meta.select(KEY, "controlled"), KEY), F.col("controlled"))
    point = F.when(F.col("controlled"), F.col("point")).otherwise(-F.col("point"))
    est = est.select(KEY, "guardrail", "ok", point.alias("observed"), "se", "t_crit", F.col("m_t_pre").alias("baseline"))
    asked = meta.select(KEY, "controlled", F.explode("guardrails").alias("guardrail"))
    rows = asked.join(est, [KEY, "guardrail"], "left").join(F.broadcast(dims.guardrails(spark)), "guardrail", "left")
    known = F.coalesce(F.col("ok"), F.lit(False)) & F.col("label").isNotNull()
    limit = F.when(F.col("tol_kind") == "abs", F.col("tol")).otherwise(F.col("baseline") * F.col("tol"))
    margin = F.col("t_crit") * F.col("se")
    optimistic = F.when(F.col("worse") == "down", F.col("observed") + margin).otherwise(F.col("observed") - margin)
    rows = rows.withColumn("observed", F.when(known, F.col("observed"))).withColumn("tolerance", F.when(known, limit)).withColumn("optimistic", F.when(known, optimistic))
    fine = F.when(F.col("worse") == "down", F.col("optimistic") >= F.col("tolerance")).otherwise(F.col("optimistic") <= F.col("tolerance"))
    return rows.select(
        KEY, "guardrail", F.coalesce("label", "guardrail").alias("label"), F.when(F.col("controlled"), "did").otherwise("pre/post").alias("mode"),
        "observed", "optimistic", "baseline", "tolerance", F.coalesce(fine, F.lit(False)).alias("passed"),
    )


def summarise(results: DataFrame) -> DataFrame:
    """Per intervention: how many guardrails were named, observed and passed, and which failed."""
    entry = F.struct("guardrail", "label", "passed", F.col("observed").isNotNull().alias("observed"))
    return results.groupBy(KEY).agg(
        F.count(F.lit(1)).cast("int").alias("guardrails_total"),
        F.count(F.when(F.col("passed"), 1)).cast("int").alias("guardrails_passed"),
        F.count("observed").cast("int").alias("guardrails_observed"),
        F.array_sort(F.collect_list(entry)).alias("guardrail_results"),
    )
