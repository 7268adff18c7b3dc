import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from marginflow.functions import collections, dates, numeric, text
from marginflow.operators import series


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_variance_and_rounding(spark):
    df = spark.createDataFrame([(float(x),) for x in (2, 4, 4, 4, 5, 5, 7, 9)], "y double").withColumn("k", F.lit(1))
    row = series.describe(df, ["k"]).first()
    assert row["variance"] == pytest.approx(4.571, abs=1e-3)
    got = one(spark, *(numeric.round_cents(F.lit(x)) for x in (-2.5, 2.5, -2.6, 0.49)))
    assert list(got) == [-2, 3, -3, 0]
    empty = series.describe(df.filter("y < 0"), ["k"]).count()
    assert empty == 0
    single = series.describe(df.limit(1), ["k"]).first()
    assert (single["variance"], single["sd"]) == (0.0, 0.0)


@pytest.mark.parametrize("p,z", [(0.975, 1.95996), (0.8, 0.84162), (0.001, -3.0902), (0.999, 3.0902)])
def test_normal_quantile(spark, p, z):
    assert numeric.normal_quantile_value(p) == pytest.approx(z, abs=1e-4)
    assert one(spark, numeric.normal_quantile(F.lit(p)))[0] == pytest.approx(numeric.normal_quantile_value(p), abs=1e-12)


def test_student_t(spark):
    row = one(spark, numeric.student_t_quantile(0.95, F.lit(10)), numeric.student_t_quantile(0.975, F.lit(30)), numeric.student_t_quantile(0.95, F.lit(0)))
    assert row[0] == pytest.approx(1.812, abs=2e-3)
    assert row[1] == pytest.approx(2.042, abs=2e-3)
    assert row[2] > 2  # df under 1 is taken as 1
    with pytest.raises(ValueError):
        numeric.normal_quantile_value(1.0)


def test_dates(spark):
    d = F.lit(dt.date(2026, 9, 20))
    row = one(spark, dates.week_of(d), dates.day_of_week(d), dates.month_of(d), dates.short_date(d), dates.long_date(d), dates.month_name(d), dates.short_date(F.lit(None).cast("date")))
    assert list(row) == [dt.date(2026, 9, 14), 0, "2026-09", "20 Sep", "20 Sep 2026", "September 2026", "—"]
    assert dates.period_for("2026-09-15") == (dt.date(2026, 9, 1), dt.date(2026, 9, 14))
    assert dates.period_for("2026-09-01") == (dt.date(2026, 8, 1), dt.date(2026, 8, 31))
    assert dates.closed_period_for("2026-09-15") == (dt.date(2026, 8, 1), dt.date(2026, 8, 31))


def test_weekly_means(spark):
    rows = [("2026-09-14", 2.0), ("2026-09-15", 4.0), ("2026-09-21", 10.0)]
    df = spark.createDataFrame(rows, "d string, y double").select(F.to_date("d").alias("date"), "y")
    assert {r["date"].isoformat(): r["y"] for r in series.to_weekly(df).collect()} == {"2026-09-14": 3.0, "2026-09-21": 10.0}
    assert {r["y"] for r in series.to_weekly(df, "sum").collect()} == {6.0, 10.0}


def test_money_text(spark):
    row = one(spark, text.format_usd(F.lit(123456)), text.format_usd(F.lit(1234)), text.format_usd(F.lit(-9900)), text.format_usd(F.lit(50000), sign=True), text.format_usd(F.lit(None).cast("long")))
    assert list(row) == ["$1,235", "$12.34", "−$99.00", "+$500", "$0.00"]
    row = one(spark, text.format_pct(F.lit(0.1234)), text.format_pp(F.lit(-0.016)), text.slug(F.lit("(Cast-Iron  half)")))
    assert list(row) == ["12.3%", "−1.6pp", "CAST-IRON-HALF"]


def test_json_has_no_infinity(spark):
    df = spark.createDataFrame([(1, math.inf), (2, 3.5)], "id int, x double")
    docs = {r["id"]: r["record"] for r in collections.to_document(df, ["id"]).collect()}
    assert docs[1] == '{"id":1,"x":null}'
    back = collections.from_document(collections.to_document(df, ["id"]).select("record"), df.schema)
    assert {tuple(r) for r in back.collect()} == {(1, None), (2, 3.5)}


def test_decay(spark):
    row = one(
        spark, numeric.decay_at(F.lit("structural"), F.lit(4.0), F.lit(10)), numeric.decay_at(F.lit("upkeep"), F.lit(4.0), F.lit(4)),
        numeric.decay_at(F.lit("durable"), F.lit(20.0), F.lit(52)), numeric.decay_at(F.lit("durable"), F.lit(math.inf), F.lit(52)), numeric.decay_at(F.lit(None).cast("string"), F.lit(1.0), F.lit(9)),
    )
    assert list(row) == pytest.approx([1.0, 0.5, 0.5, 1.0, 1.0])
