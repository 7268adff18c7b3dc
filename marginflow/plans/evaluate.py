"""Evaluation of all declared interventions in one set-based plan."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.dates import day, to_date
from ..operators import guardrails, measure, persistence, verify
from ..session import durable

KEY = measure.KEY
Day = str | dt.date


@dataclass
class Register:
    """Service-grain tables."""

    services: DataFrame
    item_days: DataFrame
    invoices: DataFrame
    menu: DataFrame
    role_shifts: DataFrame | None = None
    skus: DataFrame | None = None
    dayparts: DataFrame | None = None
    locations: DataFrame | None = None


@dataclass
class Evaluation:
    evals: DataFrame
    pairs: DataFrame
    guardrails: DataFrame
    effects: DataFrame


def closed_windows(plans: DataFrame, as_of: Day) -> DataFrame:
    """Eligibility date, whether the change was executed and whether its window has closed."""
    eligible = F.date_add("exec_on", F.col("latency_days") + F.col("window_days"))
    executed = F.col("fidelity").isin("complete", "modified", "partial")
    return (
        plans.withColumn("eligible_on", eligible)
        .withColumn("executed", executed)
        .withColumn("window_closed", F.col("executed") & (F.col("eligible_on") <= day(to_date(as_of))))
    )


def judge(plans: DataFrame, estimates: DataFrame, results: DataFrame, quality: DataFrame) -> DataFrame:
    """Verdict columns of every plan (state not yet considered)."""
    meta = [
        KEY, "lever", "fidelity", "min_obs", "preferred_obs", "rung", "incremental_cost_cents", "recurring_cost_cents", "overlap_status", "overlap_cents",
        "projected_cents",
    ]
    rows = plans.select(*meta).join(estimates, KEY, "left").join(guardrails.summarise(results), KEY, "left")
    return verify.verify(rows.join(quality.select(KEY, "data_pass"), KEY, "left"))


def evaluate_interventions(plans: DataFrame, register: Register, feeds: DataFrame, as_of: Day) -> Evaluation:
    """Series, estimate, guardrails, verdict, persistence, accrual and reversal of every plan.

    The daily means, the series, their moments and the verdicts are read several times
    each, so they are written once to the shared checkpoint folder.
    """
    if "reversal_on" not in plans.columns:
        plans = plans.withColumn("reversal_on", F.lit(None).cast("date"))
    staged = closed_windows(plans, as_of)
    bought = (register.invoices, register.item_days, register.menu)
    scoped = measure.scope_days(plans, register.services, as_of)
    pairs = measure.build_series(scoped, *bought, as_of, whole=False)
    moments = durable(measure.service_moments(scoped))
    raw = measure.measure_interventions(scoped, *bought, as_of, moments)
    scaled = measure.scale_to_week(raw, plans, measure.window_volume(scoped, *bought), as_of)
    results = guardrails.run_guardrails(plans, moments)
    verdicts = judge(plans, scaled, results, verify.data_quality(plans, feeds))
    extra = [c for c in verdicts.columns if c != KEY and c not in staged.columns]
    rows = staged.join(verdicts.select(KEY, *extra), KEY).join(measure.observed_services(scoped, as_of), KEY, "left")
    pending = ~F.col("window_closed")
    outcome = F.when(pending, "pending").otherwise(F.col("outcome"))
    rows = rows.withColumn("why", F.when(pending, F.lit("The measurement window is still open.")).otherwise(F.col("why")))
    rows = rows.withColumn("outcome", outcome).withColumn("bookable_cents", F.when(~pending, F.col("bookable_cents")))
    rows = rows.withColumn("observed", F.when(F.col("executed") & pending, F.coalesce("observed", F.lit(0))).otherwise(0))
    closed = F.create_map(*(F.lit(x) for kv in dims.CLOSED_STATE.items() for x in kv))[F.col("outcome")]
    waiting = F.coalesce(F.col("lifecycle_state") if "lifecycle_state" in plans.columns else F.lit(None), F.lit("approved"))
    state = F.when(~F.col("executed"), waiting).when(pending, "measuring").otherwise(F.coalesce(closed, F.lit("closed")))
    rows = durable(rows.withColumn("verdict_state", state))
    effects = persistence.effect_over_time(pairs, rows, as_of)
    lasting = persistence.persistence(effects, plans).drop("slope", "ci_lo", "ci_hi")
    rows = rows.join(lasting, KEY, "left")
    status = F.when(F.col("bookable_cents").isNotNull(), F.coalesce("persistence_status", F.lit("not_assessed")))
    rows = rows.withColumn("persistence_status", status).withColumn("checks", F.coalesce("checks", F.lit(0)))
    monitored = F.when(F.col("persistence_status") == "decaying", "decayed").when(F.col("checks") >= 1, "persistent").otherwise("persistence_monitoring")
    rows = rows.withColumn("state", F.when(F.col("bookable_cents").isNotNull(), monitored).otherwise(F.col("verdict_state")))
    evals = persistence.apply_reversals(persistence.realize(rows, as_of), as_of)
    return Evaluation(evals, pairs.pairs(), results, effects)
