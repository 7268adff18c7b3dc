"""Order lines are joined once per query."""

import datetime as dt

from marginflow.queries.register_queries import item_days, role_shifts, services
from marginflow.queries.views import BASE_SCHEMAS, Inputs


def test_lines_are_joined_once_for_all_readers(spark, tmp_path):
    at = dt.datetime(2001, 5, 1)
    rows = {name: [] for name in BASE_SCHEMAS} | {
        "region": [(0, "r")], "nation": [(1, "n", 0)], "customer": [(7, "c", 1, 1.0, "m")], "part": [(3, "p", "Brand#3", "server", 4, 900.0)],
        "orders": [(k, 7, "F", 1.0, at, "x") for k in (1, 2)], "lineitem": [(k, 3, 5, n, 4.0, 100.0, 0.1, 0.02, "R", "F", at) for k in (1, 2, 2) for n in (1, 2)],
    }
    for name, ddl in BASE_SCHEMAS.items():
        spark.createDataFrame(rows[name], ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    plain, inp = Inputs(spark, str(tmp_path)), Inputs(spark, str(tmp_path))
    made = services(inp)
    assert made.first()["covers"] == 8 and inp.staged("reg_order_items") is inp.staged("reg_order_items")
    for read in (item_days, role_shifts, lambda i: i.view("reg_order_items")):
        got, want = read(inp), read(plain)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.columns == want.columns
        assert "l_orderkey" not in got._jdf.queryExecution().optimizedPlan().toString()
