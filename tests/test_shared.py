"""What many plans, findings or readers have in common is made once."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from marginflow.operators import costing, measure, persistence, series

DAY0 = dt.date(2024, 1, 1)


def shared_and_pairs(spark, n=12):
    """Plans that share one daily and one weekly series, as such and as pairs of their own."""
    points = [(name, DAY0 + dt.timedelta(k * step), 10.0 + (k * 7) % 5 + (3 if k * step > 90 else 0), None if k % 9 == 4 else 8.0 + (k * 3) % 4) for name, step in (("d", 1), ("w", 7)) for k in range(182 // step)]
    plans = [(f"P{i}", "dw"[i % 2], DAY0, DAY0 + dt.timedelta(181), DAY0 + dt.timedelta(70 + 5 * i), 56, 28) for i in range(n)]
    plans = spark.createDataFrame(plans, "intervention_id string, series string, lo date, hi date, exec_on date, baseline_days int, window_days int")
    made = measure.Series(plans.select("intervention_id", "series", "lo", "hi"), spark.createDataFrame(points, "series string, date date, t double, c double"))
    return made, plans


@pytest.mark.parametrize("method", [measure.did, measure.reconcile])
def test_estimates_of_shared_series_equal_those_of_pairs(spark, method):
    made, plans = shared_and_pairs(spark)
    got, want = ({r["intervention_id"]: r.asDict() for r in method(x, plans).collect()} for x in (made, made.pairs()))
    assert set(got) == set(want) and len(got) == 12
    for key, row in want.items():
        for name, value in row.items():
            assert got[key][name] == (pytest.approx(value, rel=1e-7, abs=1e-7) if isinstance(value, float) else value), (key, name)


def test_effects_of_shared_series_equal_each_cut_by_itself(spark):
    made, plans = shared_and_pairs(spark)
    claims = plans.drop("series", "lo", "hi", "window_days").withColumns({"eligible_on": F.date_add("exec_on", 28), "estimator": F.when(F.col("intervention_id") < "P3", "did").otherwise("reconcile"), "sign": F.lit(1), "week_factor": F.lit(2.0), "bookable_cents": F.lit(50)})
    none = claims.limit(1).withColumn("intervention_id", F.lit("none"))
    as_of = DAY0 + dt.timedelta(170)
    got = {(r["intervention_id"], r["date"]): r["y"] for r in persistence.effect_over_time(made, claims.unionByName(none), as_of).collect()}
    pairs = {}
    for r in made.pairs().collect():
        pairs.setdefault(r["intervention_id"], []).append(r)
    mean = lambda rows, c: sum(r[c] for r in rows if r[c] is not None) / max(1, sum(r[c] is not None for r in rows))
    size = lambda rows, c: sum(r[c] is not None for r in rows)
    seen = 0
    for p in claims.collect():
        cut = p["eligible_on"]
        while cut <= as_of:
            pre = [r for r in pairs[p["intervention_id"]] if p["exec_on"] - dt.timedelta(56) <= r["date"] < p["exec_on"]]
            post = [r for r in pairs[p["intervention_id"]] if p["exec_on"] <= r["date"] < cut]
            if p["estimator"] == "did":
                ok = min(size(post, "t"), size(post, "c")) >= 2 and min(size(pre, "t"), size(pre, "c")) >= 4
                y = mean(post, "t") - mean(pre, "t") - (mean(post, "c") - mean(pre, "c"))
            else:
                ok, y = size(pre, "t") >= 3 and size(post, "t") >= 2, mean(pre, "t") - mean(post, "t")
            assert got[p["intervention_id"], cut] == pytest.approx(max(0, 2 * y) if ok else 50, abs=1e-9)
            cut, seen = cut + dt.timedelta(7), seen + 1
    assert seen + sum(k == "none" for k, _ in got) == len(got) and {v for (k, _), v in got.items() if k == "none"} == {50.0}


def test_effects_carry_what_is_known_of_their_claim(spark):
    made, plans = shared_and_pairs(spark, 4)
    claims = plans.drop("series", "lo", "hi", "window_days").withColumns({"eligible_on": F.date_add("exec_on", 28), "estimator": F.lit("did"), "sign": F.lit(1), "week_factor": F.lit(2.0), "bookable_cents": F.lit(50), "ok": F.col("intervention_id") != "P2"})
    as_of = DAY0 + dt.timedelta(170)
    key = lambda rows: sorted((r["intervention_id"], r["date"], r["y"]) for r in rows)
    got = persistence.effect_over_time(made, claims, as_of, also=["ok"]).collect()
    assert key(got) == key(persistence.effect_over_time(made, claims, as_of).collect())
    assert {(r["intervention_id"], r["ok"]) for r in got} == {("P0", True), ("P1", True), ("P2", False), ("P3", True)}


def test_counterfactuals_of_one_view_are_drawn_once(spark):
    made, plans = shared_and_pairs(spark, 4)
    twins = plans.unionByName(plans.withColumn("intervention_id", F.concat("intervention_id", F.lit("x"))))
    made = measure.Series(twins.select("intervention_id", "series", "lo", "hi"), made.points)
    pairs, members = made.by_date(twins)
    assert pairs.select("intervention_id").distinct().count() == 4 and members.count() == 8
    drawn = members.join(series.counterfactual_series(pairs).withColumnRenamed("intervention_id", "series"), "series").select("intervention_id", "date", "t", "c", "counterfactual")
    want = series.counterfactual_series(made.pairs().join(twins.select("intervention_id", "exec_on"), "intervention_id")).select("intervention_id", "date", "t", "c", "counterfactual")
    key = lambda r: (r["intervention_id"], r["date"])
    assert sorted(map(key, drawn.collect())) == sorted(map(key, want.collect()))
    assert {key(r): r["counterfactual"] for r in drawn.collect()} == pytest.approx({key(r): r["counterfactual"] for r in want.collect()})


def test_a_basket_is_priced_once_for_all_its_plans(spark):
    monday = lambda k: DAY0 + dt.timedelta(7 * k)
    invoices = spark.createDataFrame([("a", monday(k), s, 100 + k, 2.0, 200) for k in range(20) for s in ("S1", "S2")], "loc string, week date, sku string, unit_price_cents int, qty double, extended_cents int")
    plans = spark.createDataFrame([(f"P{i}", "t", ["S1", "S2"], monday(10)) for i in range(30)], "intervention_id string, arm string, skus array<string>, exec_on date")
    spans = plans.select("intervention_id", F.lit(monday(2)).alias("lo"), F.lit(monday(15)).alias("hi"))
    out = costing.indexed_price_series(plans, invoices, spans)
    rows = out.collect()
    assert len(rows) == 30 * 14 and {r["date"] for r in rows} == {monday(k) for k in range(2, 16)}
    assert [r["y"] for r in rows if r["date"] == monday(10)] == pytest.approx([110] * 30)
    # Nothing is summed by plan and arm.
    assert not re.search(r"Aggregate \[intervention_id#\d+, arm", out._jdf.queryExecution().optimizedPlan().toString())
