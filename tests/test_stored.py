"""Documents hold series that are collected once."""

import datetime as dt

import pytest

from marginflow.sources import documents

pq = pytest.importorskip("pyarrow.parquet")
DAY0 = dt.date(2024, 1, 1)


def test_a_shared_series_is_collected_once_and_cut_in_the_document(spark):
    flat = spark.createDataFrame([(f"F-{i}", "CMP", "oak" if i % 2 else "ala", "L", "detected") for i in range(8)], "id string, detector string, loc string, daypart string, state string")
    values = spark.createDataFrame([(loc, "L", DAY0 + dt.timedelta(k), float(k)) for loc in ("oak", "ala") for k in range(50)], "loc string, daypart string, date date, v double")
    refs = spark.createDataFrame([], "id string, other_id string, cents bigint")
    new = documents.finding_documents(flat, values, refs, by=("loc", "daypart"))
    own = documents.finding_documents(flat, flat.join(values, ["loc", "daypart"]).select("id", "date", "v"), refs)
    assert sorted(map(tuple, new.collect())) == sorted(map(tuple, own.collect()))
    chart = documents.charts(documents.read_findings(new), points=12)
    assert {(r["idx"], r["v"]) for r in chart.collect()} == {(i + 1, 38.0 + i) for i in range(12)}
    assert "slice(" in chart._jdf.queryExecution().optimizedPlan().toString()


def test_a_reader_holds_few_stored_documents_at_once(spark, tmp_path):
    many = spark.createDataFrame([(f"F-{i}", "CMP", "oak", "L", "detected") for i in range(300)], "id string, detector string, loc string, daypart string, state string")
    values = spark.createDataFrame([("oak", "L", DAY0 + dt.timedelta(k), float(k)) for k in range(50)], "loc string, daypart string, date date, v double")
    refs = spark.createDataFrame([], "id string, other_id string, cents bigint")
    flat, new = documents.flat_documents(many.filter("id < 'F-2'")), documents.finding_documents(many.filter("id >= 'F-2'"), values, refs, by=("loc", "daypart"))
    for layout in (flat, new):
        documents.write_documents(layout.coalesce(1), str(tmp_path / "documents"))
    stored = spark.read.parquet(str(tmp_path / "documents"))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, flat.unionByName(new).collect()))
    groups = [f.metadata.row_group(i).num_rows for f in map(pq.ParquetFile, (tmp_path / "documents").glob("*.parquet")) for i in range(f.num_row_groups)]
    assert sum(groups) == 300 and max(groups) <= documents.GROUP_ROWS
