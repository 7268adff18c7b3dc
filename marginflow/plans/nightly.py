"""The nightly job over stored tables, and landing a slice before it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.collections import finite
from ..functions.dates import closed_period_for, day, to_date
from ..operators import detectors, feeds as feed_ops, ledger, lifecycle, persistence
from ..session import durable
from ..schemas import columns, ddl
from ..sources import register as reg
from ..sources import keyed, store
from .detect import detection_pass
from .evaluate import Register, evaluate_interventions

Day = str | dt.date
SYSTEM = "System · nightly job"


FINDINGS = columns(
    "id string, detector string, lever string, loc string, locs array<string>, daypart string, dow int, sku string, account string, feeds array<string>, "
    "guardrails array<string>, exposure_cents bigint, recoverable_cents bigint, ev_per_hour bigint, evidence_count int, effort_hours double, risk string, latency_days int, "
    "onset_date date, signal_date date, blocked boolean, qualified boolean, overlap_status string, overlap_cents bigint, state string, state_reason string, detected_on date, "
    "decision_opened_on date, expires_on date, converted_to string, historical boolean, org_id string"
)
EVALS = columns(
    "intervention_id string, finding_id string, lever string, loc string, locs array<string>, state string, outcome string, why string, window_closed boolean, eligible_on date, "
    "exec_on date, decided_on date, reversal_on date, fidelity string, projected_cents bigint, bookable_cents bigint, reversed_claim_cents bigint, point double, mde double, "
    "persistence_status string, persistence_class string, half_life_weeks double, retention double, checks int, elapsed_weeks int, realized_cents bigint, weeks_held bigint, "
    "annual_run_rate_cents bigint, adjustment_cents bigint, weeks_booked bigint, observed bigint, org_id string"
)
ADJUSTMENTS = columns("id string, kind string, intervention_id string, loc string, cents bigint, status string, on_date date, original_cents bigint, weeks bigint, org_id string")
AUDIT = columns("on_date date, actor string, entity_kind string, entity_id string, event string, from_state string, to_state string, reason string, run bigint, org_id string")
VERDICTS = columns("intervention_id string, as_of date, outcome string, bookable_cents bigint, run bigint, org_id string")
EVENT_KEY = ("entity_kind", "entity_id", "event", "from_state", "to_state")
SIDES = columns("intervention_id string, period string, status string, claim_cents bigint, observed_cents bigint, timing_cents bigint, unexplained_cents bigint, org_id string")
RUNS = columns("as_of date, fired bigint, transitions bigint, notes string, org_id string")


#: Buckets of a tenant's records; a night rewrites those that changed.
BUCKETS = 16


def record_table(path: str, name: str) -> keyed.KeyedTable:
    """A keyed record table of the nightly job, by tenant and bucket of its key."""
    schema, key = {"findings": (FINDINGS, "id"), "evaluations": (EVALS, "intervention_id"), "adjustments": (ADJUSTMENTS, "id")}[name]
    return keyed.KeyedTable(f"{path}/{name}", ddl(schema), (key,), ("org_id",), BUCKETS)


@dataclass
class NightlyResult:
    as_of: dt.date
    fired: int
    transitions: int
    skipped: str | None = None


def _shape(rows: DataFrame, schema: dict[str, str], org: str) -> DataFrame:
    """Rows in the stored layout of a record table."""
    has = set(rows.columns)
    cols = []
    for name, kind in schema.items():
        value = F.lit(org) if name == "org_id" else F.col(name) if name in has else F.lit(None)
        cols.append(value.cast(kind).alias(name))
    return rows.select(*cols)


#: Weeks before today that the detectors look at, and one for the start of a week.
DETECTION_WEEKS = 53


def first_day(declarations: DataFrame | None, today: dt.date) -> dt.date:
    """The first day of services that a run needs: the detectors' window, or the earliest baseline. Invoices and item-days are read whole."""
    lo = today - dt.timedelta(weeks=DETECTION_WEEKS)
    if declarations is None:
        return lo
    earliest = declarations.agg(F.min(F.date_sub("exec_on", F.col("baseline_days")))).first()[0]
    return lo if earliest is None else min(lo, earliest - dt.timedelta(days=7))


def nightly(
    spark: SparkSession, path: str, org: str, as_of: Day, register_through: Day | None, declarations: DataFrame | None, feed_rows: DataFrame,
    accounting: DataFrame | None = None, server_roles: Sequence[str] = ("server",), th: detectors.Thresholds = detectors.DEFAULTS,
) -> NightlyResult:
    """Detect, evaluate and record at ``as_of``. A second run on the same day changes nothing.

    A run's number is the count of finished runs; its row in ``pipeline_runs`` is written last. Logs are written before
    the records they tell of. A run that dies is repeated under its number: what it had logged stays and is not
    logged again, and records it had not replaced are replaced.

    ``declarations``: plans of the tenant's interventions; ``accounting``: observed
    ledger movement (intervention_id, status, observed_cents, timing_cents, unexplained_cents).
    """
    today = to_date(as_of)
    tenant = F.col("org_id") == org
    record = lambda name, schema: store.read_records(spark, f"{path}/{name}", ddl(schema)).filter(tenant)
    kept = lambda name: record_table(path, name).read(spark).filter(tenant)
    number = record("pipeline_runs", RUNS).count()
    if register_through is None:
        run = spark.range(1).select(F.lit(today).alias("as_of"), F.lit(0).alias("fired"), F.lit(0).alias("transitions"), F.lit("No register yet.").alias("notes"))
        store.append_log(_shape(run, RUNS, org), f"{path}/pipeline_runs")
        return NightlyResult(today, 0, 0, "no register")

    first = first_day(declarations, today)
    tables = reg.load_register(spark, path, org, {"services": first, "shifts": first, "reservation_days": first})
    register = Register(
        tables["services"], tables["item_days"], tables["invoices"], tables["menu"], tables["shifts"], tables["skus"], tables["dayparts"], tables["locations"]
    )
    newest = feed_ops.feed_newest(day(today), day(to_date(register_through)))
    feeds = durable(feed_ops.feed_health(feed_rows.withColumn("newest", newest), today))

    before = durable(kept("findings"))
    prior = before.filter(~F.coalesce("historical", F.lit(False)))
    passed = lifecycle.expire_stale(detection_pass(register, feeds, today, prior, server_roles, th), today)
    live = durable(_shape(passed, FINDINGS, org))
    audit = lifecycle.audit_diff(before, live, today, SYSTEM)
    fired = live.count()

    events = [_shape(audit, AUDIT, org)]
    verdicts = None
    if declarations is not None:
        old = durable(kept("evaluations"))
        result = evaluate_interventions(declarations, register, feeds, today)
        evals = durable(_shape(result.evals.withColumn("half_life_weeks", finite(F.col("half_life_weeks"))), EVALS, org))
        known = old.select("intervention_id", F.col("state").alias("from_state"), F.col("outcome").alias("_outcome"), F.col("window_closed").alias("_closed"))
        joined = evals.join(known, "intervention_id", "left")
        moved = joined.filter(F.col("from_state").isNull() | (F.col("from_state") != F.col("state")))
        actor = F.when(F.col("state").isin("measuring", "executed"), F.lit(SYSTEM)).otherwise(F.lit("Verification decision service"))
        events.append(
            _shape(
                moved.select(
                    F.lit(today).alias("on_date"), actor.alias("actor"), F.lit("intervention").alias("entity_kind"), F.col("intervention_id").alias("entity_id"),
                    F.col("state").alias("event"), "from_state", F.col("state").alias("to_state"), F.col("why").alias("reason"),
                ),
                AUDIT, org,
            )
        )
        changed = F.col("window_closed") & (F.col("_outcome").isNull() | (F.col("_outcome") != F.col("outcome")) | ~F.coalesce("_closed", F.lit(False)))
        verdicts = _shape(joined.filter(changed).withColumn("as_of", F.lit(today)), VERDICTS, org)
        existing = durable(kept("adjustments"))
        numbered = durable(persistence.number_adjustments(existing, persistence.derive_adjustments(evals, today)))
        added = numbered.join(existing.select("id"), "id", "left_anti")
        events.append(
            _shape(
                added.select(
                    F.lit(today).alias("on_date"), F.lit(SYSTEM).alias("actor"), F.lit("adjustment").alias("entity_kind"), F.col("id").alias("entity_id"), F.lower("kind").alias("event"),
                    F.lit(None).cast("string").alias("from_state"), F.col("status").alias("to_state"), F.lit(None).cast("string").alias("reason"),
                ),
                AUDIT, org,
            )
        )

    trail = events[0]
    for more in events[1:]:
        trail = trail.unionByName(more)
    trail = durable(trail.withColumn("run", F.lit(number).cast("bigint")))

    # Everything is computed; from here on only writes: logs first, then the records.
    this_run = F.col("run") == number
    store.append_once(trail, record("audit_events", AUDIT).filter(this_run), f"{path}/audit_events", EVENT_KEY)
    transitions = record("audit_events", AUDIT).filter(this_run).count()
    if verdicts is not None:
        verdicts = durable(verdicts.withColumn("run", F.lit(number).cast("bigint")))
        store.append_once(verdicts, record("verification_results", VERDICTS).filter(this_run), f"{path}/verification_results", ("intervention_id", "outcome"))
    keyed.upsert(spark, record_table(path, "findings"), live)
    if declarations is not None:
        lo, hi = closed_period_for(today)
        keyed.upsert(spark, record_table(path, "evaluations"), evals)
        keyed.restate(spark, record_table(path, "adjustments"), _shape(numbered, ADJUSTMENTS, org))
        if accounting is not None:
            claims = ledger.accrual_in_period(evals, today, lo, hi).filter(F.col("period_cents") > 0)
            booked = claims.join(accounting, "intervention_id").withColumn("claim_cents", F.col("period_cents")).withColumn("period", F.lit(lo.strftime("%Y-%m")))
            store.replace_tenant(_shape(booked, SIDES, org), f"{path}/ledger_sides", org)
    run = spark.range(1).select(
        F.lit(today).alias("as_of"), F.lit(fired).alias("fired"), F.lit(transitions).alias("transitions"), F.lit(f"{transitions} transitions.").alias("notes")
    )
    store.append_log(_shape(run, RUNS, org), f"{path}/pipeline_runs")
    return NightlyResult(today, fired, transitions)


def land_and_run(
    spark: SparkSession, path: str, org: str, current: Day, to_day: Day, rows: dict[str, DataFrame], declarations: DataFrame | None, feed_rows: DataFrame, **options
) -> NightlyResult:
    """Lands a slice of register through the day before ``to_day``, then runs the nightly job there."""
    now, then = to_date(current), to_date(to_day)
    if then <= now:
        raise ValueError(f"the clock only moves forward ({now} → {then})")
    reg.land_increment(rows, path, org, reg.landed_marks(spark, path, org))
    return nightly(spark, path, org, then, then - dt.timedelta(days=1), declarations, feed_rows, **options)
