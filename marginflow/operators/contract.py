"""What a figure says, what it rests on and how fresh that is: contracts of figures, from their lineage."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.dates import to_date

Day = str | dt.date


def _table(spark: SparkSession, rows: list[tuple[str, str]], names: str) -> DataFrame:
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names.split()))


def lineage(spark: SparkSession) -> DataFrame:
    """(figure, code): every feed that a figure rests on, however many equations lie between.

    The walk goes from a figure to its equations, from an equation to what it reads, and from an input to the feeds that
    deliver it. All three tables are fixed vocabularies of a few dozen rows.
    """
    begins = _table(spark, [(f, e) for f, (_, uses) in dims.FIGURES.items() for e in uses], "figure node")
    reads = _table(spark, [(e, i) for e, inputs in dims.EQUATION_INPUTS.items() for i in inputs], "node read")
    delivers = _table(spark, [(i, f) for i, feeds in dims.INPUT_FEEDS.items() for f in feeds], "node code")
    # Equations of one generation read those of the generation before, so the depth is known.
    depth, reach = _depth(), begins
    steps = [begins]
    for _ in range(depth):
        reach = reach.join(F.broadcast(reads), "node").select("figure", F.col("read").alias("node")).distinct()
        steps.append(reach)
    walked = steps[0]
    for more in steps[1:]:
        walked = walked.unionByName(more)
    return walked.distinct().join(F.broadcast(delivers), "node").select("figure", "code").distinct()


def _depth() -> int:
    """Longest chain of equations that read equations."""
    known: dict[str, int] = {}

    def below(name: str) -> int:
        if name not in known:
            known[name] = 1 + max(map(below, dims.EQUATION_INPUTS[name])) if name in dims.EQUATION_INPUTS else 0
        return known[name]

    return max(map(below, dims.EQUATION_INPUTS))


def figure_sources(feeds: DataFrame) -> DataFrame:
    """Per figure: its feeds, the day up to which all of them have delivered, and those that are stale or never did.

    ``feeds``: (code, newest, stale). A feed that is not in the catalogue has never delivered. ``fresh_through`` is null if one
    feed never delivered, and for figures that rest on no feed.
    """
    met = lineage(feeds.sparkSession).join(F.broadcast(feeds.select("code", "newest", "stale", F.lit(True).alias("_known"))), "code", "left")
    names = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("code"))))
    never = F.col("newest").isNull()
    return met.groupBy("figure").agg(
        names(F.lit(True)).alias("feeds"), names(never).alias("never"), names(F.coalesce("stale", F.lit(False))).alias("stale_feeds"),
        F.when(F.count(F.when(never, 1)) == 0, F.min("newest")).alias("fresh_through"),
    )


def metric_contracts(kpi_rows: DataFrame, feeds: DataFrame, since: Day, through: Day) -> DataFrame:
    """The ten attributes of every figure of every scope; an attribute that is not known is null.

    Lineage, freshness and status come from the feeds that deliver: a figure one of whose feeds never did has neither.
    """
    c = F.col
    spark = kpi_rows.sparkSession
    says = F.broadcast(_table(spark, [(f, text) for f, (text, _) in dims.FIGURES.items()], "figure definition"))
    strength = F.create_map(*(F.lit(x) for k, v in dims.CLAIM_CLASSES.items() for x in (k, v[0])))
    # One row per figure, of a fixed vocabulary.
    sources = F.broadcast(figure_sources(feeds))
    rows = kpi_rows.withColumnRenamed("kpi", "figure").join(says, "figure", "left").join(sources, "figure", "left")
    whole = c("fresh_through").isNotNull()
    stale = F.when(F.size("stale_feeds") > 0, F.concat(F.lit("waits for "), F.array_join("stale_feeds", ", "))).otherwise(F.lit("up to date"))
    return rows.select(
        "scope", c("figure").alias("kpi"), "definition", F.lit(f"{to_date(since).isoformat()} to {to_date(through).isoformat()}").alias("date_range"),
        F.when(c("scope") == "all", "every room").otherwise(F.concat(F.lit("room "), c("scope"))).alias("location_scope"),
        F.when(whole, stale).alias("status"), F.coalesce(strength[c("klass")], F.lit("none")).alias("confidence"),
        F.date_format("fresh_through", "yyyy-MM-dd").alias("freshness"), F.when(whole, F.array_join("feeds", " + ")).alias("lineage"), c("figure").alias("drill_to"),
        F.lit("after a second closed period").alias("change_explanation"), F.lit(dims.CALC_VERSION).alias("calc_version"),
    )


def contract_gaps(contracts: DataFrame) -> DataFrame:
    """Attributes that are missing or empty, one row each."""
    cells = F.array(*(F.struct(F.lit(f).alias("attribute"), F.col(f).alias("value")) for f in dims.METRIC_CONTRACT_FIELDS))
    return contracts.select("scope", "kpi", F.inline(cells)).filter(F.coalesce(F.col("value") == "", F.lit(True))).drop("value")
