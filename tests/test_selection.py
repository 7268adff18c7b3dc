"""Order statistics by selection, apportionment by a cut, and the weighted mean at any weight."""

import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginflow.operators import ledger, selection, spc

CASES = {
    "even": [float(k) for k in range(500)], "ties": [float(k % 3) for k in range(400)], "one": [7.5], "same": [2.0] * 300,
    "wide": [10.0**k * s for k in range(-300, 300, 7) for s in (1, -1)], "far": [-1e308, 1e308, 0.0, 5e-324, float("inf"), float("-inf")] * 30, None: [0.1 * k for k in range(350)],
}


def grouped(spark):
    rows = [(k, v) for k, vs in CASES.items() for v in vs] + [("even", None)] * 40 + [("none", None)] * 5
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "g string, y double").repartition(5)


def test_values_at_every_rank(spark):
    wanted = spark.createDataFrame([(k, r) for k, vs in CASES.items() for r in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1, len(vs)}], "g string, rank bigint")
    got = {(r["g"], r["rank"]): r["value"] for r in selection.values_at(grouped(spark), ["g"], "y", wanted).collect()}
    assert got == {(k, r): sorted(vs)[r] for k, vs in CASES.items() for r in {0, len(vs) // 3, len(vs) // 2, len(vs) - 1}}


@pytest.mark.parametrize("direct", [0, 320, 10**6])
def test_quantiles_at_any_size(spark, direct):
    levels = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p93": 0.93, "p100": 1.0}
    df = grouped(spark).filter("g is null or g <> 'far'")
    got = {r["g"]: r for r in selection.quantiles(df, ["g"], levels, "y", direct_rows=direct).collect()}
    assert set(got) == {*CASES, "none"} - {"far"}
    for k, vs in CASES.items():
        for name, q in levels.items():
            if k != "far":
                assert got[k][name] == pytest.approx(np.quantile(vs, q), rel=1e-12, abs=1e-290)
    assert got["none"]["p50"] == 0


def test_selection_moves_no_row_of_the_fact(spark):
    """A round sends counts, not values: what is shuffled follows the steps, whatever the rows."""
    df = spark.range(50_000).select(F.lit("g").alias("g"), (F.col("id") * 37 % 50_021).cast("double").alias("y"))
    wanted = spark.createDataFrame([("g", 25_000)], "g string, rank bigint")
    got = selection.values_at(df, ["g"], "y", wanted).first()["value"]
    assert got == sorted(k * 37 % 50_021 for k in range(50_000))[25_000]


@pytest.mark.parametrize("direct", [0, 5, 10**6])
def test_apportion_by_cut(spark, direct):
    draw = random.Random(4)
    rows, want = [], {}
    for k in range(25):
        n, total = draw.choice([1, 3, 8, 40]), draw.choice([0, 1, 99, 1234])
        weights = [float(draw.choice([0, 1, 2, 3])) if k % 5 else 0.0 for _ in range(n)]
        places = draw.sample(range(1000), n)
        key = None if k == 7 else f"c{k}"
        rows += [(key, total, p, w) for p, w in zip(places, weights)]
        whole = sum(weights)
        parts = {}
        if whole <= 0:
            parts = {p: total // n for p in places}
            parts[min(places)] += total - sum(parts.values())
        else:
            raw = {p: Fraction(total * w / whole) for p, w in zip(places, weights)}
            parts = {p: int(x) for p, x in raw.items()}
            for p in sorted(raw, key=lambda p: (parts[p] - raw[p], p))[: total - sum(parts.values())]:
                parts[p] += 1
        want |= {(key, p): c for p, c in parts.items()}
    df = spark.createDataFrame(rows, "claim string, total int, pos int, weight double").repartition(4)
    got = {(r["claim"], r["pos"]): r["part"] for r in ledger.apportion(df, ["claim"], direct_rows=direct).collect()}
    assert got == want


@pytest.mark.parametrize(("lam", "n"), [(0.001, 100_000), (0.25, 700), (1.0, 300), (0.6, 129)])
def test_ewma_keeps_every_point(spark, lam, n):
    df = spark.range(n).select(F.lit("s").alias("k"), F.date_add(F.lit("1700-01-01").cast("date"), F.col("id").cast("int")).alias("date"), (F.col("id") * 7919 % 1009 + F.when(F.col("id") < 40, 1e6).otherwise(0.0)).alias("v"))
    out = spc.ewma_chart(df, ["k"], lam=lam).select("i", "v", "mu", "z").orderBy("i").collect()
    z = out[0]["mu"]
    for r in out:
        z = lam * r["v"] + (1 - lam) * z
        assert r["z"] == pytest.approx(z, rel=1e-9, abs=1e-9)
