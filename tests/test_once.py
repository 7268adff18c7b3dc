"""Tables are joined, written and added up once, however many rules, streams or look-ups read them."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from marginflow.operators import contracts, costing, measure
from marginflow.operators.contracts import Contract, Reference
from marginflow.queries import QUERIES
from marginflow.queries import job_queries as jobs
from marginflow.queries import measure_queries
from marginflow.queries.register_queries import services
from marginflow.queries.registry import tidy
from marginflow.queries.views import BASE_SCHEMAS, Inputs
from marginflow.session import scratch_dir

DAY0 = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    path, at = str(tmp_path_factory.mktemp("tables")), dt.datetime(2001, 5, 1)
    rows = {name: [] for name in BASE_SCHEMAS} | {
        "region": [(0, "r")], "nation": [(1, "n", 0)], "customer": [(7, "c", 1, 1.0, "m")], "part": [(3, "p", "Brand#3", "server", 4, 900.0)], "supplier": [(5, "s", 1, 1.0)],
        "orders": [(k, 7, "F", 1.0, at, "x") for k in (811 + 1, 997 + 5, 23, 43)], "lineitem": [(k, 3, 5, n, 4.0, 100.0, 0.1, 0.02, "R", "F", at) for k in (812, 1002, 23, 23) for n in (1, 2)],
    }
    for name, ddl in BASE_SCHEMAS.items():
        spark.createDataFrame(rows[name], ddl).write.parquet(f"{path}/{name}.parquet")
    return path


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_no_texts_are_gathered_per_key_or_reference(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id int")
    child = spark.createDataFrame([(9, 1, 5), (10, 4, -1), (9, 4, None), (100, None, -3), (None, 2, 7)], "k int, parent int, n int")
    spec = {"parents": Contract(("id",)), "child": Contract(("k",), {"n is positive": "n > 0"}, references=(Reference("parent is there", ("parent",), "parents", ("id",)),))}
    out = contracts.check_contracts({"parents": parents, "child": child}, spec)
    # A grouped least text would sort all rows.
    assert not re.search(r"SortAggregate\(key=\[[^\]]", out._jdf.queryExecution().executedPlan().toString())
    assert {(r["table"], r["rule"]): tuple(r)[2:] for r in out.collect()} == {
        ("parents", "key is unique"): (2, 0, None, None), ("child", "n is positive"): (5, 3, "10", "9"), ("child", "key is unique"): (5, 2, "9", "9"), ("child", "parent is there"): (5, 2, "10", "9"),
    }


def test_spoiled_tables_read_lines_that_are_joined_once(spark, tables):
    made, inp = jobs.spoiled_tables(Inputs(spark, tables)), Inputs(spark, tables)
    for name, df in made.items():
        assert "l_orderkey" not in plan(df) and "o_orderkey" not in plan(df), name
    for name in ("checks", "order_items", "shifts", "reviews", "invoices", "findings"):
        view, values, repeated = jobs.SPOILED[name]
        rows = inp.view(view)
        want = rows.withColumns({c: F.expr(text) for c, text in values.items()}).unionByName(rows.filter(repeated))
        assert made[name].dtypes == want.dtypes and sorted(map(str, made[name].collect())) == sorted(map(str, want.collect())), name


def test_streams_share_lines_that_are_written_once(spark, tables):
    folder = scratch_dir(spark)
    before = set(os.listdir(folder.removeprefix("file:")))
    got = QUERIES["stream_service_rollup"](spark, tables).collect()
    new = [x for x in set(os.listdir(folder.removeprefix("file:"))) - before if re.match(r"(reg_)?(order_items|shifts)", x)]
    assert len(new) == 1 and new[0].startswith("reg_order_items")
    assert sorted(map(str, got)) == sorted(map(str, tidy(services(Inputs(spark, tables))).collect())) and len(got) == 1


def test_rows_in_many_files_come_in_two_deliveries(spark, tmp_path):
    spark.range(100).repartition(11).write.parquet(f"{tmp_path}/rows")
    batches = []
    jobs.in_two(spark, spark.read.parquet(f"{tmp_path}/rows")).writeStream.foreachBatch(lambda b, n: batches.append(b.count())).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 2 and sum(batches) == 100


def test_sums_of_invoices_stand_for_them(spark):
    monday = lambda k: DAY0 + dt.timedelta(7 * k)
    invoices = spark.createDataFrame([(loc, monday(k), s, 100 + k + n, 2.0 + n, 200 + n) for k in range(12) for s in ("S1", "S2") for loc in "ab" for n in range(3)], "loc string, week date, sku string, unit_price_cents bigint, qty double, extended_cents bigint")
    sums = costing.weekly_invoices(invoices)
    assert sums.count() == 48 and {r["lines"] for r in sums.collect()} == {3}
    plans = spark.createDataFrame([(f"P{i}", "t", ["S1", "S2"], monday(6)) for i in range(3)], "intervention_id string, arm string, skus array<string>, exec_on date")
    spans = plans.select("intervention_id", F.lit(monday(2)).alias("lo"), F.lit(monday(9)).alias("hi"))
    sold = spark.createDataFrame([("a", monday(k), "i", 7) for k in range(12)], "loc string, date date, item string, units bigint")
    menu = spark.createDataFrame([("i", "S1", 0.5)], "item string, uses_sku string, qty_per_unit double")
    arms = spark.createDataFrame([("P0", "t", 1, "S1", ["a"], monday(6))], "intervention_id string, arm string, sign int, sku string, locs array<string>, exec_on date")
    for read in (lambda x: costing.indexed_price_series(plans, x, spans), lambda x: costing.frozen_price_usage(arms, x, sold, menu, spans)):
        got, want = ({(r["intervention_id"], r["date"]): r["y"] for r in read(x).collect()} for x in (sums, invoices))
        assert len(got) >= 8 and got == pytest.approx(want)


def test_the_register_of_evaluations_is_made_once(spark, tables):
    inp = Inputs(spark, tables)
    made = measure_queries.register(inp)
    assert "l_orderkey" not in plan(made.invoices) and "l_suppkey" not in plan(made.invoices) and "p_brand" not in plan(made.menu)
    assert "s_suppkey" not in plan(measure.scope_days(measure_queries.plans(inp), made.services, "2001-08-02").plans)
