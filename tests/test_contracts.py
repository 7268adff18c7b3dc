"""Contracts of tables against brute force, contracts of figures, and findings stored as documents."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from marginflow import dims
from marginflow.operators import contract, contracts, report
from marginflow.sources import documents, register as reg
from marginflow.operators.contracts import Contract, Reference


def test_rules_keys_and_references(spark):
    parents = spark.createDataFrame([("a", 1), ("b", 2), ("b", 2), (None, 3)], "id string, day int")
    rows = [(1, "a", 1, 5), (2, "a", 2, -1), (2, "b", 2, None), (3, "z", 9, 1), (4, None, 0, 1), (None, "b", 2, 7)]
    child = spark.createDataFrame(rows, "k int, parent string, day int, n int")
    spec = {
        "parents": Contract(("id",)),
        "child": Contract(("k",), {"n is positive": "n > 0"}, references=(Reference("parent is there", ("parent",), "parents", ("id",)), Reference("and of its day", ("parent",), "parents", ("id",), ("day",)))),
    }
    got = {(r["table"], r["rule"]): tuple(r)[2:] for r in contracts.check_contracts({"parents": parents, "child": child}, spec).collect()}
    assert got == {
        ("parents", "key is unique"): (4, 2, "b", "b"),
        ("child", "n is positive"): (6, 2, "2", "2"), ("child", "key is unique"): (6, 2, "2", "2"),
        ("child", "parent is there"): (6, 1, "3", "3"), ("child", "and of its day"): (6, 2, "2", "3"),
    }
    none = contracts.check_contracts({"parents": parents.limit(0), "child": child.limit(0)}, spec)
    assert [(r["rows"], r["violations"], r["first_key"]) for r in none.collect()] == [(0, 0, None)] * 5


def test_contracts_cover_every_table_and_known_columns():
    assert len(contracts.CONTRACTS) >= 22
    for name, spec in contracts.CONTRACTS.items():
        assert spec.key and (spec.rules or spec.unique), name
        assert all(r.table in contracts.CONTRACTS and len(r.columns) == len(r.their) for r in spec.references), name


def test_every_figure_has_its_feeds(spark):
    got = {}
    for r in contract.lineage(spark).collect():
        got.setdefault(r["figure"], set()).add(r["code"])

    def feeds(node):
        return set(dims.INPUT_FEEDS.get(node, ())).union(*(feeds(n) for n in dims.EQUATION_INPUTS.get(node, ())))

    assert got == {f: set().union(*(feeds(n) for n in uses)) for f, (_, uses) in dims.FIGURES.items()} and all(got.values())


def test_a_feed_that_never_delivered_leaves_gaps(spark):
    day = dt.date(2026, 3, 1)
    codes = sorted({c for feeds in dims.INPUT_FEEDS.values() for c in feeds})
    rows = [(c, None if c == "accounting" else day if c == "invoices" else day + dt.timedelta(9), c == "invoices") for c in codes]
    kpis = spark.createDataFrame([(s, k, 1.0, "bookable") for s in ("all", "oak") for k in dims.FIGURES], "scope string, kpi string, value double, klass string")
    made = contract.metric_contracts(kpis, spark.createDataFrame(rows, "code string, newest date, stale boolean"), "2026-03-01", "2026-03-31")
    by = {(r["scope"], r["kpi"]): r for r in made.collect()}
    assert set(made.columns) == {"scope", "kpi", *dims.METRIC_CONTRACT_FIELDS}
    assert by["oak", "recon"]["freshness"] is None and by["oak", "exposure"]["freshness"] == "2026-03-01" and by["all", "verified"]["freshness"] == "2026-03-10"
    assert by["all", "exposure"]["status"] == "waits for invoices" and by["all", "verified"]["status"] == "up to date"
    gaps = {(r["scope"], r["kpi"], r["attribute"]) for r in contract.contract_gaps(made).collect()}
    assert gaps == {(s, k, a) for s in ("all", "oak") for k in ("recon", "reconciledValue") for a in ("status", "freshness", "lineage")}


def test_documents_of_both_layouts_are_read(spark):
    flat = spark.createDataFrame([("F-1", "CMP", "comps", "oak", ["oak"], "L", 700, 9, "detected"), ("F-2", "CMP", "comps", "ala", ["ala"], "L", 800, 12, "qualified")], "id string, detector string, lever string, loc string, locs array<string>, daypart string, exposure_cents bigint, evidence_count int, state string")
    days = [dt.date(2026, 1, 1) + dt.timedelta(k) for k in range(40)]
    points = spark.createDataFrame([("F-2", d, 1.0 + k % 3 + (9 if k == 39 else 0)) for k, d in enumerate(days)] + [("F-2", days[0] - dt.timedelta(1), float("inf"))], "id string, date date, v double")
    refs = spark.createDataFrame([("F-2", "F-9", 55), ("F-2", "F-8", 5)], "id string, other_id string, cents bigint")
    tests = spark.createDataFrame([("F-2", True, False)], "id string, data boolean, worth boolean")
    extra = spark.range(1).select(F.lit("F-2").alias("id"), F.from_json(F.lit('{"comps": {"actual": 0.03, "baseline": 0.01}}'), documents._schema(f"e {documents.EXTRA}")["e"].dataType).alias("extra"))
    stored = documents.flat_documents(flat.limit(1)).unionByName(documents.finding_documents(flat.filter("id = 'F-2'"), points, refs, tests, extra))
    stored = stored.unionByName(spark.createDataFrame([("F-3", "detected", '{"version": 3, "id": "F-3", "state": "detected", "unheard_of": [1]}')], "id string, state string, record string"))
    rows = {r["id"]: r for r in documents.read_findings(stored).collect()}
    assert (rows["F-1"]["version"], rows["F-1"]["series"], rows["F-1"]["overlaps"], rows["F-1"]["tests"]) == (1, [], [], None)
    two = rows["F-2"]
    assert two["version"] == 2 and len(two["series"]) == 41 and [o["other_id"] for o in two["overlaps"]] == ["F-8", "F-9"] and two["tests"]["data"] and not two["tests"]["worth"] and two["tests"]["overlap"] is None
    assert two["extra"]["comps"]["actual"] == 0.03 and two["extra"]["price"] is None and two["locs"] == ["ala"] and rows["F-3"]["version"] == 3
    chart = documents.charts(documents.read_findings(stored), points=20).collect()
    assert {r["id"] for r in chart} == {"F-2"} and len(chart) == 20 and [r["date"] for r in chart if r["outside"]] == [days[-1]]


def test_positions_outlive_shuffles(spark):
    cards = spark.createDataFrame([(f"c{k}", k % 4, None if k % 3 else k * 10) for k in range(50)], "id string, rank int, money_cents bigint").repartition(7)
    got = sorted((r["position"], r["id"]) for r in report.placed(cards, report.queue_order()).repartition(5).collect())
    want = sorted(((r["rank"], -(r["money_cents"] or 0), r["id"]) for r in cards.collect()))
    assert [i for _, i in got] == [i for *_, i in want] and [p for p, _ in got] == list(range(1, 51))


def test_the_first_day_prunes_weeks(spark, tmp_path):
    rows = spark.range(400).select(F.lit("oak").alias("loc"), F.date_add(F.lit("2025-01-01").cast("date"), F.col("id").cast("int")).alias("date"), F.lit("L").alias("daypart"))
    cols = reg.REGISTER_TABLES["services"]
    reg.land_increment({"services": rows.select(*((F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in cols.items()))}, str(tmp_path), "o1")
    part = reg.load_table(spark, str(tmp_path), "services", "o1", "2025-12-17")
    assert part.count() == 400 - 350
    plan = part._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters:") :].split("PushedFilters")[0]
    assert "week" in filters and "org_id" in filters
    read = lambda df: df.select(F.input_file_name().alias("f")).distinct().count()
    assert read(part) <= 8 < read(reg.load_table(spark, str(tmp_path), "services", "o1"))


@pytest.mark.parametrize("name", ["loc", "week"])
def test_a_null_rule_is_broken(spark, name):
    df = spark.createDataFrame([(1, None)], f"id int, {name} string")
    out = contracts.check_rows("t", df, Contract(("id",), {"named": f"{name} <> ''"}, unique=False)).first()
    assert (out["violations"], out["first_key"]) == (1, "1")
