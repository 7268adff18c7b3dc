"""One detection pass: seven detectors, overlap, qualification, size, state and window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import to_date
from ..operators import detectors, lifecycle, overlap
from ..session import durable
from .evaluate import Register

Day = str | dt.date


def fire(
    register: Register, feeds: DataFrame, as_of: Day, server_roles: Sequence[str] = ("server",), th: detectors.Thresholds = detectors.DEFAULTS
) -> DataFrame:
    """Findings of all detectors in one layout."""
    r = register
    found = {
        "LAB": detectors.detect_excess_hours(r.services, r.role_shifts, r.dayparts, as_of, server_roles, th),
        "PPV": detectors.detect_price_variance(r.invoices, as_of, th),
        "POR": detectors.detect_usage_drift(r.invoices, r.item_days, r.menu, r.skus, as_of, th),
        "CMP": detectors.detect_comps_rate(r.services, as_of, th),
        "PRC": detectors.detect_underpriced_item(r.item_days, r.services, r.menu, as_of, th),
        "MIX": detectors.detect_mix_shift(r.item_days, as_of, th),
        "TKT": detectors.detect_ticket_drift(r.services, r.item_days, as_of, feeds, th),
    }
    out = None
    for code, rows in found.items():
        part = detectors.findings_of(code, rows, as_of)
        out = part if out is None else out.unionByName(part)
    return out


def detection_pass(
    register: Register, feeds: DataFrame, as_of: Day, prior: DataFrame, server_roles: Sequence[str] = ("server",),
    th: detectors.Thresholds = detectors.DEFAULTS,
) -> DataFrame:
    """Fired findings with overlap, qualification, recoverable cents, state and decision window.

    The fired findings are few but expensive, and read three times, so they are
    made durable once.
    """
    found = durable(fire(register, feeds, as_of, server_roles, th))
    year, week, _ = to_date(as_of).isocalendar()
    claims = found.withColumn("amount_cents", F.col("exposure_cents")).withColumn("period", F.lit(f"{year}-W{week:02d}")).withColumn("rung", F.lit(2))
    resolved = overlap.resolve_overlaps(claims, overlap.sku_intersections(found)).drop("amount_cents", "period", "rung")
    sized = lifecycle.size_findings(lifecycle.qualify(resolved, feeds))
    staged = lifecycle.decision_window(lifecycle.assign_states(sized, prior), as_of)
    return staged.withColumn("historical", F.lit(False))
