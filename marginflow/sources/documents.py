"""Findings as documents: nested, versioned, and readable without the register.

A stored finding keeps, beside its flat columns, the series that its detector judged, the tests it passed, the findings it
shares dollars with and what its detector alone knows. Readers take every layout that was ever written: columns that a
layout lacks come back empty (lists) or null, and columns that a reader does not know stay in the stored text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from ..functions.collections import finite
from ..operators import series as series_ops

VERSION = 2
_FLAT = (
    "id string, detector string, lever string, loc string, locs array<string>, daypart string, dow int, sku string, account string, feeds array<string>, guardrails array<string>, equations array<string>, "
    "exposure_cents bigint, recoverable_cents bigint, evidence_count int, effort_hours double, risk string, latency_days int, onset_date date, signal_date date, state string, detected_on date, "
    "decision_opened_on date, expires_on date, historical boolean"
)
POINT = "struct<date: date, v: double>"
TESTS = "struct<data: boolean, feasible: boolean, worth: boolean, overlap: boolean>"
OVERLAP = "struct<other_id: string, cents: bigint>"
#: What one detector alone knows, by detector; a document fills the one of its own.
EXTRA = (
    "struct<hours: struct<mu: double, delta_hours: double>, price: struct<p0: double, p1: double, price_leg: double, quantity_leg: double>, usage: struct<r0: double, r1: double, excess_qty: double>, "
    "comps: struct<actual: double, baseline: double>, menu: struct<elasticity: double, target: double>, mix: struct<mix_effect: double, cross_effect: double>, ticket: struct<t0: double, t1: double, constrained_share: double>>"
)
#: A document is as long as its series, and a reader holds thousands of rows of a row group at once; so groups are short.
GROUP_ROWS = 64
#: The layout that readers get: the newest, of which every older one is a part.
LAYOUT = f"version int, {_FLAT}, baseline_n int, series array<{POINT}>, tests {TESTS}, overlaps array<{OVERLAP}>, extra {EXTRA}"


def _schema(text: str) -> T.StructType:
    return T._parse_datatype_string(text)


def _shaped(rows: DataFrame, layout: str) -> list:
    has = set(rows.columns)
    out = []
    for f in _schema(layout).fields:
        value = (F.col(f.name) if f.name in has else F.lit(None)).cast(f.dataType)
        out.append((finite(value) if isinstance(f.dataType, T.DoubleType) else value).alias(f.name))
    return out


def _written(rows: DataFrame, layout: str) -> DataFrame:
    """The columns that listings filter by, and the whole document as JSON."""
    return rows.select("id", "state", F.to_json(F.struct(*_shaped(rows, layout))).alias("record"))


def flat_documents(findings: DataFrame) -> DataFrame:
    """Documents of the first layout: flat columns only, and no version."""
    return _written(findings, _FLAT)


def finding_documents(findings: DataFrame, points: DataFrame, refs: DataFrame, tests: DataFrame | None = None, extra: DataFrame | None = None, baseline_n: int = 28, by: Sequence[str] = ("id",)) -> DataFrame:
    """Documents of the newest layout.

    ``points``: (id, date, v), or with ``by`` the columns of a finding that name its series; ``refs``: (id, other_id, cents); ``tests``: (id and any of the tests); ``extra``: (id, extra).
    A series is one point per date and a finding shares dollars with a handful of others, so a document stays small. A series
    that many findings judge is made once and handed to them last, when nothing more is shuffled.
    """
    charted = points.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("date", F.col("v").cast("double").alias("v")))).alias("series"))
    shared = refs.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("other_id", F.col("cents").cast("bigint").alias("cents")))).alias("overlaps"))
    rows = findings.drop("series", "overlaps", "tests", "extra")
    if tuple(by) != ("id",):
        rows = rows.withColumn("_copies", F.count(F.lit(1)).over(W.partitionBy("id")).cast("int"))
    rows = rows.join(shared, "id", "left")
    if tests is not None:
        names = [f.name for f in _schema(f"t {TESTS}")["t"].dataType.fields]
        given = F.struct(*((F.col(n) if n in tests.columns else F.lit(None)).cast("boolean").alias(n) for n in names))
        rows = rows.join(tests.select("id", given.alias("tests")), "id", "left")
    if extra is not None:
        rows = rows.join(extra.select("id", "extra"), "id", "left")
    rows = rows.join(charted, list(by), "left")
    if tuple(by) != ("id",):
        # A finding that comes twice has its points twice.
        repeated = F.flatten(F.transform("series", lambda p: F.array_repeat(p, F.col("_copies"))))
        rows = rows.withColumn("series", F.when(F.col("_copies") > 1, repeated).otherwise(F.col("series"))).drop("_copies")
    return _written(rows.withColumn("version", F.lit(VERSION)).withColumn("baseline_n", F.lit(baseline_n)), LAYOUT)


def write_documents(documents: DataFrame, path: str) -> None:
    """Documents of any layout added to a folder. Those of one series lie together and repeat it, which zstd folds."""
    documents.write.mode("append").option("compression", "zstd").option("parquet.block.row.count.limit", GROUP_ROWS).parquet(path)


def read_findings(stored: DataFrame) -> DataFrame:
    """Stored documents of any layout in the newest one."""
    rows = stored.select(F.from_json("record", _schema(LAYOUT)).alias("_r")).select("_r.*")
    none = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>"))
    return rows.withColumns({"version": F.coalesce("version", F.lit(1)), "series": none("series", POINT), "overlaps": none("overlaps", OVERLAP)})


def charts(findings: DataFrame, points: int = 160) -> DataFrame:
    """The control chart of every stored finding that has a series; only the points it shows leave the document."""
    recent = F.slice(F.sort_array("series"), F.greatest(F.size("series") - points + 1, F.lit(1)), points)
    long = findings.select("id", F.inline(recent))
    return series_ops.control_chart_frame(long, ["id"], points=points)
