"""Registered queries against their SQL on the smallest test folder, and the shape of plans."""

import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))
SF = "/root/testdata/sf0.001"

check = pytest.importorskip("check_oracles")
from marginflow.queries import ORACLES, QUERIES  # noqa: E402

FAST = [
    "service_rollup", "item_day_rollup", "price_as_of", "weekly_series", "cusum_chart", "drift_onsets", "weekly_unit_price", "usage_ratio", "detect_price_variance",
    "qualified_findings", "resolved_overlaps", "finding_states", "applied_decisions", "accrual_daily", "adjustments", "funnel", "apportion_claims", "feed_risk", "queue_cards",
]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, con, name):
    ok, text = check.compare(name, spark, con, SF)
    assert ok, text


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["effect_over_time", "persistence_fit"])
def test_effects_of_every_claim_come_with_its_estimate(con, name):
    made = dict(con.execute(f"SELECT intervention_id, ok FROM ({ORACLES['weekly_effects']})").fetchall())
    shown = con.execute(f"SELECT DISTINCT intervention_id, ok FROM ({ORACLES[name]})").fetchall()
    assert {ok for _, ok in shown} == {True, False} and all(made[key] == ok for key, ok in shown)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
@pytest.mark.parametrize("name", ["service_rollup", "detect_comps_rate", "detect_mix_shift", "kpis_by_scope", "resolved_overlaps"])
def test_plans_have_no_nested_loops_and_no_python(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [w for w in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython") if w in plan]


@pytest.mark.skipif(not Path(SF).exists(), reason="test tables are not here")
def test_scan_reads_only_what_a_query_needs(spark):
    plan = QUERIES["weekly_unit_price"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_comment" not in plan and "l_returnflag" not in plan and "l_tax" not in plan
    assert "LessThan(l_shipdate" in plan
