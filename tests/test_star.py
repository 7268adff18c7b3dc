"""Star facts of the ledger and window sums from running sums, against brute force."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from marginflow.operators import ledger, measure, prefix, star

ROOMS = [f"R{i}" for i in range(7)]


@pytest.fixture(scope="module")
def rooms(spark):
    return spark.createDataFrame([(r,) for r in ROOMS], "loc string")


def claims(spark, n=300, seed=5):
    draw = random.Random(seed)
    rows = []
    for k in range(n):
        kind = draw.randrange(4)
        locs = None if kind == 0 else draw.sample(ROOMS, draw.randint(1, 5)) if kind == 1 else sorted(ROOMS) if kind == 2 else []
        loc = "group" if kind in (0, 2) else draw.choice(ROOMS)
        rows.append((f"C{k}", loc, locs, draw.choice([None, 0, 1, -1, 2 * k, 99_999 - k, -7 * k]), draw.choice(["x", "y"])))
    return spark.createDataFrame(rows, "id string, loc string, locs array<string>, cents bigint, kind string"), rows


def split(cents, parts):
    size, sign = abs(cents), -1 if cents < 0 else 1
    return [sign * (size // parts + (p < size % parts)) for p in range(parts)]


def test_claims_by_scope_equal_their_expansion(spark, rooms):
    df, rows = claims(spark)
    entries = {"a": (F.col("kind") == "x", F.col("cents")), "b": (F.lit(True), F.col("cents"))}
    got = {r["scope"]: r for r in star.by_scope(star.added_up(star.claims(df, entries), rooms), rooms, ["a", "b"]).collect()}
    want = {(s, f): [0, 0] for s in [*ROOMS, "all"] for f in "ab"}
    for _, loc, locs, cents, kind in rows:
        for f in ("ab" if kind == "x" else "b"):
            named = locs or (sorted(ROOMS) if loc == "group" else [loc])
            want["all", f][0] += cents or 0
            want["all", f][1] += 1
            for room, part in zip(named, split(cents or 0, len(named))):
                want[room, f][0] += part
                want[room, f][1] += loc != "group"
            if loc == "group":
                for room in ROOMS:
                    want[room, f][1] += 1
    assert set(got) == {*ROOMS, "all"}
    assert {(s, f): [r[f"c_{f}"], r[f"n_{f}"]] for s, r in got.items() for f in "ab"} == want


def test_each_pipeline_of_claims_is_read_once(spark, rooms, tmp_path):
    """The rows of a source are counted by an accumulator while the figures are made and read."""
    df, rows = claims(spark, 100)
    df.repartition(4).write.parquet(str(tmp_path / "claims"))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    counted = spark.read.parquet(str(tmp_path / "claims")).mapInArrow(count, df.schema)
    star.by_scope(star.added_up(star.claims(counted, {"a": (F.lit(True), F.col("cents"))}), rooms), rooms, ["a"]).collect()
    assert seen.value == len(rows)


def test_no_claims(spark, rooms):
    df, _ = claims(spark, 1)
    got = star.by_scope(star.added_up(star.claims(df.limit(0), {"a": (F.lit(True), F.col("cents"))}), rooms), rooms, ["a"]).collect()
    assert len(got) == len(ROOMS) + 1 and all(r["c_a"] == r["n_a"] == 0 for r in got)


def test_lag_medians_count_group_claims_in_every_room(spark, rooms):
    draw = random.Random(3)
    rows = [(draw.choice([*ROOMS, "group"]), draw.choice([None, 1, 5, 8, 30])) for _ in range(200)]
    df = spark.createDataFrame(rows, "loc string, days int").withColumn("locs", F.lit(None).cast("array<string>"))
    lags = df.select(star.room_set().alias("rooms"), (F.col("loc") == "group").alias("of_group"), "days")
    got = {r["scope"]: r["days"] for r in ledger._lag_medians(lags, rooms, ["days"]).collect()}
    for s in [*ROOMS, "all"]:
        assert got[s] == statistics.median([d for loc, d in rows if d is not None and (s == "all" or loc in (s, "group"))])


def test_shares_of_the_whole_group(spark, rooms):
    df = spark.createDataFrame([("d1", "*", 70.0), ("d1", "R0" + star.BETWEEN + "R3", 10.0), ("d2", "R1", 4.0)], "day string, rooms string, amount double")
    got = {(r["day"], r["scope"]): r["amount"] for r in star.shares(df, rooms, ["day"]).collect()}
    assert got["d1", "all"] == 80 and got["d1", "R0"] == got["d1", "R3"] == 15 and got["d1", "R6"] == 10 and got["d2", "R1"] == 4 and ("d2", "R0") not in got


def test_window_moments_equal_direct_ones(spark):
    """Running sums against the direct aggregate: constant stretches, gaps, one-sided days and empty windows."""
    draw, day = random.Random(9), dt.date(2024, 1, 1)
    points = []
    for key in ("s1", "s2", "s3"):
        for d in range(0, 200, draw.choice([1, 1, 7])):
            steady = 50 < d < 120
            t = 12.1 if steady else draw.gauss(1000, 40)
            points.append((key, day + dt.timedelta(d), draw.choice([t, t, t, None]), draw.choice([3 * t + draw.gauss(0, 5), None, 5.5])))
    points = [p for p in points if p[2] is not None or p[3] is not None]
    asks = [(f"P{k}", draw.choice(["s1", "s2", "s3", "none"]), day + dt.timedelta(draw.randint(-20, 220)), draw.choice([14, 28, 56]), draw.choice([7, 28])) for k in range(60)]
    series = spark.createDataFrame(points, "scope string, date date, t double, c double")
    plans = spark.createDataFrame(asks, "intervention_id string, scope string, exec_on date, baseline_days int, window_days int")
    asked = prefix.ends(plans, ["scope"], measure._window_ends(), also=["intervention_id"])
    got = {r["intervention_id"]: r for r in prefix.cell_moments(asked, prefix.moments_before(series, asked, ["scope"]), ["scope"], ["intervention_id"], measure.CELLS, "pre").collect()}
    direct = measure.cell_moments(plans.join(series, "scope").select("intervention_id", "date", "t", "c"), plans)
    want = {r["intervention_id"]: r for r in direct.collect()}
    assert len(got) == 60 and len(want) > 30
    for key, w in want.items():
        for name in [c for c in direct.columns if c[:2] in ("n_", "m_", "v_") or c == "fit"]:
            assert got[key][name] == pytest.approx(w[name], rel=1e-7, abs=1e-7), (key, name)
            assert (got[key][name] == 0) == (w[name] == 0) or name[0] in "mf", (key, name)
    for key in set(got) - set(want):
        assert all(got[key][f"n_{a}_{c}"] == 0 for a in "tc" for c in measure.CELLS)


def test_plans_of_one_scope_share_its_days(spark):
    services = spark.createDataFrame(
        [(loc, dt.date(2024, 1, 1) + dt.timedelta(d), "F", d % 7, 10 + d % 5, 1000 * (d % 3), 50) for loc in ("a", "b", "c") for d in range(60)],
        "loc string, date date, daypart string, dow int, covers bigint, labor_cents bigint, comps_cents bigint",
    )
    for name in ("net_cents", "cogs_cents", "gross_cents"):
        services = services.withColumn(name, F.lit(100).cast("bigint"))
    for name in ("ticket_min", "rating", "hours"):
        services = services.withColumn(name, F.lit(4.0))
    row = ("labour_per_cover", "cover", dt.date(2024, 1, 29), 28, 14, False, ["overtime"])
    plans = spark.createDataFrame(
        [("P1", ["a", "b"], *row), ("P2", ["b", "a"], *row), ("P3", ["c"], *row)],
        "intervention_id string, treat_locs array<string>, metric string, grain string, exec_on date, baseline_days int, window_days int, weekly boolean, guardrails array<string>",
    )
    none = {c: F.lit(None).cast("array<string>") for c in ("treat_dayparts", "control_locs", "control_dayparts")} | {c: F.lit(None).cast("array<int>") for c in ("treat_dows", "control_dows")}
    scoped = measure.scope_days(plans.withColumns(none).withColumn("control_others", F.lit(True)), services, "2024-03-01")
    assert scoped.plans.select("scope").distinct().count() == 2 and scoped.days.count() == 120
    rows = {(r["intervention_id"], r["series"]): r for r in measure.service_moments(scoped).collect()}
    assert len(rows) == 6
    for name in ("n_t_pre", "m_t_pre", "v_t_pre", "m_c_post", "fit"):
        assert rows["P1", "labour_per_cover"][name] == rows["P2", "labour_per_cover"][name]
    assert rows["P1", "labour_per_cover"]["n_t_pre"] == 28 and rows["P1", "g_overtime"]["v_t_pre"] == 0
