"""Planted register through detection, the nightly job and the streams."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from marginflow.operators import feeds as feed_ops
from marginflow.operators import spc
from marginflow.plans import detect, evaluate
from marginflow.plans import nightly as nightly_module
from marginflow.plans.nightly import land_and_run, nightly
from marginflow.session import durable
from marginflow.sources import register as reg
from marginflow.streaming.cusum import stream_cusum
from marginflow.streaming.land import stream_to_parquet

import fixtures as fx


@pytest.fixture(scope="module")
def register(spark):
    return evaluate.Register(
        durable(fx.services(spark)), durable(fx.item_days(spark)), durable(fx.invoices(spark)), fx.menu(spark), durable(fx.role_shifts(spark)), fx.skus(spark), fx.dayparts(spark), fx.locations(spark)
    )


@pytest.fixture(scope="module")
def feeds(spark):
    rows = fx.feed_rows(spark).withColumn("newest", feed_ops.feed_newest(F.lit(fx.AS_OF), F.lit(fx.AS_OF - dt.timedelta(days=1))))
    return feed_ops.feed_health(rows, fx.AS_OF)


@pytest.fixture(scope="module")
def findings(spark, register, feeds):
    none = spark.createDataFrame([], "id string, state string, state_reason string, detected_on date, decision_opened_on date, expires_on date, converted_to string")
    return {r["id"]: r for r in detect.detection_pass(register, feeds, fx.AS_OF, none).collect()}


def near(day, offset, tolerance):
    return abs((day - fx.START).days - offset) <= tolerance


def test_planted_signals_are_found_and_dated(findings):
    assert {"F-PPV-SK1", "F-POR-OAK-SK1", "F-CMP-BRK-DINNER", "F-TKT-ALA-LUNCH", "F-MIX-ALA", "F-LAB-OAK-DINNER-TUE"} <= set(findings)
    assert near(findings["F-CMP-BRK-DINNER"]["onset_date"], 147, 3)
    assert near(findings["F-TKT-ALA-LUNCH"]["onset_date"], 133, 3)
    assert near(findings["F-PPV-SK1"]["onset_date"], 7 * 17, 14)
    assert near(findings["F-LAB-OAK-DINNER-TUE"]["onset_date"], 98, 14)


def test_nothing_else_fires(findings):
    assert {i for i in findings if i.startswith(("F-CMP", "F-TKT", "F-MIX", "F-PPV"))} == {"F-PPV-SK1", "F-CMP-BRK-DINNER", "F-TKT-ALA-LUNCH", "F-MIX-ALA"}
    assert {i for i in findings if i.startswith("F-LAB")} == {"F-LAB-OAK-DINNER-TUE"}


def test_shared_dollars_are_counted_once(findings):
    price, usage = findings["F-PPV-SK1"], findings["F-POR-OAK-SK1"]
    assert usage["overlap_status"] == "holds" and price["overlap_status"] == "reduced"
    shared = [int(f["excess_qty"] * (price["p1"] - price["p0"]) + 0.5) for i, f in findings.items() if i.startswith("F-POR")]
    assert price["overlap_cents"] == sum(shared) > 0
    assert price["recoverable_cents"] == int(price["exposure_cents"] * 0.66 + 0.5) - price["overlap_cents"]


def test_blocked_and_ready_states(findings):
    assert findings["F-TKT-ALA-LUNCH"]["state"] == "data_insufficient" and findings["F-TKT-ALA-LUNCH"]["blocked"]
    assert findings["F-CMP-BRK-DINNER"]["state"] == "awaiting_decision"


@pytest.fixture(scope="module")
def stored(spark, register):
    path = tempfile.mkdtemp(prefix="marginflow-test-")
    facts = {"services": register.services, "item_days": register.item_days, "shifts": register.role_shifts, "invoices": register.invoices, "reservation_days": fx.reservation_days(spark)}
    cut = fx.AS_OF - dt.timedelta(days=7)
    early = {n: rows.filter(F.col(reg.FACTS[n]) < F.lit(cut)) for n, rows in facts.items()}
    for org in ("o1", "o2"):
        reg.land_increment(early, path, org)
        for name, rows in (("locations", fx.locations(spark)), ("dayparts", register.dayparts), ("menu", register.menu), ("skus", register.skus), ("roles", fx.roles(spark))):
            reg.write_dimension(rows, path, name, org)
    return path, facts, cut


def test_nightly_is_idempotent_and_lands_forward(spark, stored, register):
    path, facts, cut = stored
    decl, feed_rows = fx.declarations(spark), fx.feed_rows(spark)
    loaded = reg.load_register(spark, path, "o1")
    assert loaded["services"].count() == register.services.filter(F.col("date") < F.lit(cut)).count()
    plan = loaded["services"].filter(F.col("date") >= F.lit(cut))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(org_id" in plan and "PushedFilters: [IsNotNull(date), GreaterThanOrEqual(date" in plan

    assert nightly(spark, path, "o3", cut, None, None, feed_rows).skipped == "no register"
    first = nightly(spark, path, "o1", cut, cut - dt.timedelta(days=1), decl, feed_rows)
    assert first.fired > 0 and first.transitions >= first.fired
    again = nightly(spark, path, "o1", cut, cut - dt.timedelta(days=1), decl, feed_rows)
    assert (again.fired, again.transitions) == (first.fired, 0)

    with pytest.raises(ValueError):
        land_and_run(spark, path, "o1", cut, cut, facts, decl, feed_rows)
    moved = land_and_run(spark, path, "o1", cut, fx.AS_OF, facts, decl, feed_rows)
    assert reg.load_table(spark, path, "services", "o1").count() == register.services.count()
    assert reg.load_table(spark, path, "services", "o2").count() == register.services.filter(F.col("date") < F.lit(cut)).count()
    repeat = nightly(spark, path, "o1", fx.AS_OF, fx.AS_OF - dt.timedelta(days=1), decl, feed_rows)
    assert repeat.transitions == 0 and repeat.fired == moved.fired

    evals = {r["intervention_id"]: r for r in spark.read.parquet(f"{path}/evaluations").collect()}
    assert evals["IV-03"]["state"] == "measuring" and evals["IV-03"]["outcome"] == "pending" and evals["IV-03"]["observed"] > 0
    assert evals["IV-01"]["window_closed"] and evals["IV-01"]["outcome"] in ("no_effect", "inconclusive", "directional", "negative", "attribution_conflict")
    verdicts = spark.read.parquet(f"{path}/verification_results").groupBy("intervention_id", "outcome").count().collect()
    assert all(r["count"] == 1 for r in verdicts)
    assert spark.read.parquet(f"{path}/pipeline_runs").count() == 5


def test_a_dead_run_is_finished_without_loss(spark, stored, register, monkeypatch):
    """The other tenant's job dies after its logs and its findings; repeated, it leaves what the first tenant's whole run left."""
    path, facts, cut = stored
    decl, feed_rows = fx.declarations(spark), fx.feed_rows(spark)
    whole = nightly_module.keyed.upsert

    def dies(session, table, rows):
        if table.path.endswith("/evaluations"):
            raise RuntimeError("lost")
        return whole(session, table, rows)

    monkeypatch.setattr(nightly_module.keyed, "upsert", dies)
    with pytest.raises(RuntimeError):
        nightly(spark, path, "o2", cut, cut - dt.timedelta(days=1), decl, feed_rows)
    monkeypatch.undo()
    nightly(spark, path, "o2", cut, cut - dt.timedelta(days=1), decl, feed_rows)
    for name, keys in (("audit_events", nightly_module.EVENT_KEY), ("verification_results", ("intervention_id", "outcome")), ("findings", ("id",)), ("evaluations", ("intervention_id", "outcome"))):
        table = spark.read.parquet(f"{path}/{name}").filter(F.col("run") == 0 if name in ("audit_events", "verification_results") else F.lit(True))
        sides = {org: sorted(table.filter(F.col("org_id") == org).select(*keys).collect(), key=str) for org in ("o1", "o2")}
        assert sides["o2"] and (sides["o1"] == sides["o2"] or name in ("findings", "evaluations"))
        assert len(set(sides["o2"])) == len(sides["o2"])
    assert spark.read.parquet(f"{path}/pipeline_runs").filter("org_id = 'o2'").count() == 1


def test_a_dead_landing_goes_on_where_each_table_stopped(spark, stored):
    path, facts, cut = stored
    reg.land_increment({"services": facts["services"]}, path, "o2", reg.landed_marks(spark, path, "o2"))
    reg.land_increment(facts, path, "o2", reg.landed_marks(spark, path, "o2"))
    for name, rows in facts.items():
        assert reg.load_table(spark, path, name, "o2").count() == rows.count(), name
    assert reg.landed_marks(spark, f"{path}/nothing", "o2") == dict.fromkeys(reg.FACTS)


def test_stream_monitor_over_many_batches(spark):
    """One file per trigger: state crosses batches, and the result equals the batch chart."""
    folder = tempfile.mkdtemp(prefix="marginflow-test-")
    start = dt.datetime(2026, 1, 1)
    rows = [(s, start + dt.timedelta(hours=i), float((i * 37 + n * 11) % 17) + (6 if i >= 60 and n == 0 else 0)) for n, s in enumerate(("a", "b")) for i in range(90)]
    points = spark.createDataFrame(rows, "series string, at timestamp, v double")
    for part in range(3):
        lo, hi = start + dt.timedelta(hours=30 * part), start + dt.timedelta(hours=30 * (part + 1))
        points.filter((F.col("at") >= F.lit(lo)) & (F.col("at") < F.lit(hi))).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream_to_parquet(stream_cusum(live), f"{folder}/out", f"{folder}/state").awaitTermination()
    got = {(r["series"], r["at"]): (r["s_hi"], r["s_lo"]) for r in spark.read.parquet(f"{folder}/out").collect()}
    chart = spc.cusum_chart(points.withColumn("date", F.col("at")), ["series"]).collect()
    assert len(got) == len(chart) == 180
    for r in chart:
        assert got[r["series"], r["at"]] == (pytest.approx(r["s_hi"], abs=1e-9), pytest.approx(r["s_lo"], abs=1e-9))


def test_stream_monitor_short_late_and_disordered(spark):
    """Points in any order within the delay, a short and a single-point series, and one point that comes too late."""
    folder = tempfile.mkdtemp(prefix="marginflow-test-")
    start = dt.datetime(2026, 1, 1)
    rows = [(s, start + dt.timedelta(hours=i), float((i * 37 + 11) % 17)) for s, n in (("a", 90), ("short", 5), ("one", 1)) for i in range(n)]
    points = spark.createDataFrame(rows, "series string, at timestamp, v double")
    hour = (F.unix_seconds("at") - F.unix_seconds(F.lit(start))) / 3600
    mark = spark.createDataFrame([(None, start + dt.timedelta(days=60), None)], points.schema)
    late = spark.createDataFrame([("a", start + dt.timedelta(hours=1, minutes=30), 5.0)], points.schema)
    turn = F.floor((hour + F.pmod(hour * 7, F.lit(10))) / 40)
    for part in (*(points.filter(turn == n).orderBy(F.desc("at")).coalesce(1) for n in range(3)), late, mark):
        part.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    live = spark.readStream.schema(points.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream_to_parquet(stream_cusum(live, delay="12 hours"), f"{folder}/out", f"{folder}/state").awaitTermination()
    found = spark.read.parquet(f"{folder}/out").collect()
    assert [(r["series"], r["at"], r["v"], r["s_hi"]) for r in found if r["signal"] == "late"] == [("a", start + dt.timedelta(hours=1, minutes=30), 5.0, None)]
    got = {(r["series"], r["at"]): (r["s_hi"], r["s_lo"]) for r in found if r["signal"] != "late"}
    chart = spc.cusum_chart(points.withColumn("date", F.col("at")), ["series"]).collect()
    assert len(found) == len(rows) + 1 and len(got) == len(chart) == len(rows)
    for r in chart:
        assert got[r["series"], r["at"]] == (pytest.approx(r["s_hi"], abs=1e-9), pytest.approx(r["s_lo"], abs=1e-9))
