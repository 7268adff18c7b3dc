"""Bucketed record tables and the streamed roll-up."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from marginflow.operators import rollup
from marginflow.sources import keyed
from marginflow.streaming import rollup as live
from marginflow.streaming.land import stream_land

SCHEMA = "org string, id bigint, v string, version int"


@pytest.fixture
def table(tmp_path):
    return keyed.KeyedTable(str(tmp_path / "t"), SCHEMA, keys=("id",), partition=("org",), buckets=8, order=("version",))


def rows(spark, *values):
    return spark.createDataFrame(list(values), SCHEMA)


def files(table):
    return {p: p.stat().st_mtime_ns for p in Path(table.path).rglob("*.parquet")}


def content(spark, table):
    return sorted(map(tuple, table.read(spark).collect()), key=repr)


def test_an_update_rewrites_its_bucket_only(spark, table):
    first = [(org, k, f"v{k}", 1) for org in ("a", "b") for k in range(200)] + [(None, 1, "none", 1), ("a", None, "null id", 1)]
    keyed.upsert(spark, table, rows(spark, *first))
    before = files(table)
    changes = keyed.upsert(spark, table, rows(spark, ("a", 7, "new", 2)))
    after = files(table)
    assert sorted((r["org"], r["id"], r["v"], r["weight"]) for r in changes.collect()) == [("a", 7, "new", 1), ("a", 7, "v7", -1)]
    gone = set(before) - set(after)
    assert len({p.parent for p in gone}) == 1 and all("org=a" in str(p) for p in gone)
    assert all(after[p] == before[p] for p in set(before) & set(after))
    assert content(spark, table) == sorted([*(r for r in first if r[:2] != ("a", 7)), ("a", 7, "new", 2)], key=repr)


def test_a_repeated_update_changes_nothing(spark, table):
    batch = rows(spark, ("a", 1, "x", 1), ("a", 2, "y", 1), (None, None, "z", 1))
    keyed.upsert(spark, table, batch)
    before = files(table)
    assert keyed.upsert(spark, table, batch).count() == 0 and files(table) == before
    assert keyed.upsert(spark, table, batch.limit(0)).count() == 0 and files(table) == before


def test_the_greatest_version_wins_and_equal_ones_are_chosen_alike(spark, table):
    batch = [("a", 1, "old", 1), ("a", 1, "new", 3), ("a", 1, "mid", 2), ("a", 2, "x", 1), ("a", 2, "y", 1)]
    keyed.upsert(spark, table, rows(spark, *batch).repartition(3))
    once = content(spark, table)
    assert once[0] == ("a", 1, "new", 3) and len(once) == 2
    chosen = [keyed.latest(rows(spark, *random.Random(k).sample(batch, 5)).repartition(k + 1), table).filter("id = 2").first()["v"] for k in range(4)]
    assert set(chosen) == {once[1][2]}


def test_landing_reads_the_folders_of_the_batch_only(spark, table):
    keyed.land(spark, table, rows(spark, *((f"w{k % 10}", k, "v", 1) for k in range(1000))))
    batch = rows(spark, ("w3", 3, "again", 1), ("w3", 5000, "fresh", 1))
    reached = keyed.reached(spark, table, batch)
    read = {r["f"] for r in reached.select(F.input_file_name().alias("f")).distinct().collect()}
    scan = reached._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan
    assert {r["org"] for r in reached.select("org").distinct().collect()} == {"w3"} and 0 < len(read) <= 2 < len(files(table))
    landed = keyed.land(spark, table, batch)
    assert [(r["id"], r["v"]) for r in landed.collect()] == [(5000, "fresh")]
    assert table.read(spark).count() == 1001


def test_restating_keeps_the_identity(spark, tmp_path):
    table = keyed.KeyedTable(str(tmp_path / "r"), "id string, kind string, cents bigint, status string", keys=("id",), buckets=4)
    make = lambda *r: spark.createDataFrame(list(r), table.schema)
    keyed.upsert(spark, table, make(("x", "Decay", 5, "open"), ("y", "Dispute", 6, "open")))
    keyed.restate(spark, table, make(("x", "changed", 9, "accepted"), ("z", "Reversal", 1, "open")))
    assert content(spark, table) == [("x", "Decay", 9, "accepted"), ("y", "Dispute", 6, "open"), ("z", "Reversal", 1, "open")]


def sources(spark):
    draw, day = random.Random(8), dt.date(2026, 1, 1)
    at = lambda: (draw.choice(["oak", "ala"]), day + dt.timedelta(draw.randrange(12)), draw.choice(["L", "D"]))
    made = {
        "checks": ("id bigint, loc string, business_date date, daypart string, guest_count bigint, subtotal_cents bigint, comp_cents bigint, voided boolean", [(k, *at(), draw.randrange(9), draw.randrange(9999), draw.choice([0, 150]), k % 9 == 0) for k in range(80)]),
        "order_items": ("id bigint, loc string, business_date date, daypart string, qty bigint, unit_cost_cents bigint, ticket_min double", [(k, *at(), 2, draw.randrange(900), draw.choice([None, 11.0, 14.5])) for k in range(150)]),
        "shifts": ("id bigint, loc string, business_date date, daypart string, clocked_hours double, wage_rate_cents bigint", [(k, *at(), draw.randrange(30) / 4, 1500 + k) for k in range(60)]),
        "reviews": ("id bigint, loc string, business_date date, daypart string, rating double", [(k, *at(), draw.choice([3.0, 4.5, None])) for k in range(15)]),
        "reservations": ("id bigint, loc string, business_date date, daypart string, turned_away bigint, constrained_share double, holiday boolean, capacity int", [(k, *at(), k % 4, draw.choice([None, 0.25]), draw.choice([None, True]), 40 + k) for k in range(40)]),
    }
    return {name: spark.createDataFrame(values, schema) for name, (schema, values) in made.items()}


def test_streamed_services_equal_the_batch_ones(spark, tmp_path):
    """Several deliveries, corrections that come later, a compaction between them, and a repeated read."""
    full, path = sources(spark), str(tmp_path)
    want = sorted(map(tuple, rollup.rollup_services(**full).collect()))
    assert live.service_rollup(spark, f"{path}/sums").count() == 0
    for turn in range(3):
        streams = {}
        for name, df in full.items():
            part = df.filter(F.col("id") % 3 == turn).withColumn("weight", F.lit(1))
            if name == "checks":
                # Wrong guests at first, taken back in the next delivery.
                wrong = lambda t: df.filter((F.col("id") % 3 == t) & (F.col("id") % 2 == 0)).withColumn("guest_count", F.col("guest_count") + 50)  # noqa: B023, E731
                part = part.unionByName(wrong((turn + 1) % 3).withColumn("weight", F.lit(1))).unionByName(wrong(turn).withColumn("weight", F.lit(-1)))
            part.repartition(2).write.mode("append").parquet(f"{path}/{name}")
            streams[name] = spark.readStream.schema(part.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/{name}")
        live.stream_service_rollup(live.arriving(**streams), f"{path}/sums", f"{path}/state").awaitTermination()
        if turn == 1:
            live.compact(spark, f"{path}/sums")
    got = live.service_rollup(spark, f"{path}/sums")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    folders = live._sums(spark, f"{path}/sums").select("first_batch", "last_batch").distinct().count()
    live.compact(spark, f"{path}/sums")
    assert sorted(map(tuple, live.service_rollup(spark, f"{path}/sums").collect())) == want
    assert live._sums(spark, f"{path}/sums").select("first_batch", "last_batch").distinct().count() == 1 < folders


def test_streamed_landing_stores_each_key_once(spark, table, tmp_path):
    source = str(tmp_path / "in")
    for n in range(3):
        rows(spark, *(("a", k, f"turn {n}", n) for k in range(10 + n))).coalesce(1).write.mode("append").parquet(source)
        stream_land(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source), table, str(tmp_path / "state")).awaitTermination()
    got = {r["id"]: r["v"] for r in table.read(spark).collect()}
    assert got == {**{k: "turn 0" for k in range(10)}, 10: "turn 1", 11: "turn 2"} and table.read(spark).count() == 12
