"""Window plans against the plain recursions on seeded series."""

import datetime as dt
import math
import statistics

import pytest
from pyspark.sql import functions as F

from marginflow.operators import spc

DAY0 = dt.date(2026, 1, 1)


def lcg(seed):
    while True:
        seed = (seed * 1103515245 + 12345) % 2**31
        yield seed / 2**30 - 1


def make(key, n, step_at=None, size=0.0, seed=7):
    g = lcg(seed)
    return [(key, DAY0 + dt.timedelta(days=i), 10 + next(g) + (size if step_at is not None and i >= step_at else 0.0)) for i in range(n)]


SERIES = make("step", 120, 60, 3.0) + make("down", 100, 50, -3.0, 11) + make("quiet", 90, seed=5) + make("short", 9, 5, 4.0, 3) + [("flat", DAY0 + dt.timedelta(days=i), 5.0) for i in range(40)]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(SERIES, "key string, date date, v double").repartition(5)


def values(key):
    return [v for k, _, v in SERIES if k == key]


def baseline(vs, n=28):
    base = vs[: max(2, min(n, len(vs)))]
    return statistics.fmean(base), statistics.stdev(base) or 1e-9


def cusum(vs, k=0.5):
    mu, sd = baseline(vs)
    hi = lo = 0.0
    out = []
    for v in vs:
        x = (v - mu) / sd
        hi, lo = max(0.0, hi + x - k), max(0.0, lo - x - k)
        out.append((hi, lo))
    return out


def best_split(vs, direction):
    n, best, at = len(vs), -math.inf, None
    if n < 6:
        return None
    for t in range(3, n - 2):
        diff = statistics.fmean(vs[t:]) - statistics.fmean(vs[:t])
        if (direction == "high" and diff <= 0) or (direction == "low" and diff >= 0):
            continue
        stat = abs(diff) * math.sqrt(t * (n - t) / n)
        if stat > best + 1e-12:
            best, at = stat, t
    return at


def onset(vs, h=4.0):
    s = cusum(vs)
    sig = next((i for i, (hi, lo) in enumerate(s) if hi > h or lo > h), None)
    if sig is None:
        return None
    d = "high" if s[sig][0] > h else "low"
    side = 0 if d == "high" else 1
    j = sig
    while j > 0 and s[j - 1][side] > 0:
        j -= 1
    lo = max(0, sig - 120)
    cp = best_split(vs[lo : min(len(vs) - 1, sig + 6) + 1], d)
    at = j if cp is None or not j <= lo + cp <= sig else lo + cp
    return at + 1, sig + 1, d


def test_cusum_equals_recursion(df):
    got = spc.cusum_chart(df, ["key"]).orderBy("key", "date").collect()
    for key in {k for k, _, _ in SERIES}:
        rows = [r for r in got if r["key"] == key]
        for r, (hi, lo) in zip(rows, cusum(values(key))):
            assert r["s_hi"] == pytest.approx(hi, abs=1e-7) and r["s_lo"] == pytest.approx(lo, abs=1e-7)
            assert (r["s_hi"] == 0) == (hi == 0) and (r["s_lo"] == 0) == (lo == 0)


def test_ewma_equals_recursion(df):
    got = spc.ewma_chart(df, ["key"]).orderBy("key", "date").collect()
    for key in ("step", "short", "flat"):
        vs = values(key)
        mu, sd = baseline(vs)
        z = mu
        for i, r in enumerate([r for r in got if r["key"] == key]):
            z = 0.25 * vs[i] + 0.75 * z
            w = 3 * sd * math.sqrt(0.25 / 1.75 * (1 - 0.75 ** (2 * (i + 1))))
            assert r["z"] == pytest.approx(z, abs=1e-9) and r["ucl"] == pytest.approx(mu + w, abs=1e-9)


def test_change_point(df):
    got = {r["key"]: r["split"] for r in spc.change_point(df, ["key"]).collect()}
    for key in ("step", "down", "short"):
        assert got[key] == best_split(values(key), None)
    assert abs(got["step"] - 60) <= 2 and abs(got["down"] - 50) <= 2
    assert spc.change_point(df, ["key"], "low").filter("key = 'step'").first()["split"] == best_split(values("step"), "low")


def test_onset(df):
    chart = spc.cusum_chart(df, ["key"])
    got = {r["key"]: (r["onset_index"], r["signal_index"], r["direction"]) for r in spc.drift_onset(chart, ["key"]).collect()}
    for key in {k for k, _, _ in SERIES}:
        assert got.get(key) == onset(values(key)), key
    assert abs(got["step"][0] - 61) <= 2 and got["step"][2] == "high" and got["down"][2] == "low"
    only_low = {r["key"] for r in spc.drift_onset(chart, ["key"], "low").collect()}
    assert "down" in only_low


def test_series_operators_share_one_exchange(df):
    plan = spc.drift_onset(spc.cusum_chart(df, ["key"]), ["key"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    assert "Python" not in plan


def test_window_of_baseline_can_vary(df):
    out = spc.baseline_moments(df, ["key"], F.when(F.col("key") == "step", 10).otherwise(5)).filter("i = 1").collect()
    want = {k: baseline(values(k), 10 if k == "step" else 5)[0] for k in {r["key"] for r in out}}
    assert {r["key"]: pytest.approx(r["mu"]) for r in out} == want
