"""Runs corpus queries in Spark and their SQL in DuckDB over one folder and compares every value: check_llm.py FOLDER NAME..."""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import __spark_entry__  # noqa: E402
from marginflow.session import local_session  # noqa: E402

folder, names = sys.argv[1], sys.argv[2:]
spark = local_session(8, "check-llm")
for name in names:
    began = time.time()
    got = __spark_entry__.queries()[name](spark, folder).toPandas()
    took = time.time() - began
    cols = sorted(got.columns)
    got = got[cols].sort_values(cols, ignore_index=True)
    print(name, f"{took:.1f} s", len(got), list(got.columns))
    if sql := __spark_entry__.oracle_sql().get(name):
        db = duckdb.connect()
        for t in "documents pages labels benchmark".split():
            p = Path(folder, f"{t}.parquet")
            db.execute(f"create view {t} as select * from read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
        want = db.execute(sql).df()[cols].sort_values(cols, ignore_index=True)
        same = len(want) == len(got) and all((got[c].isna() & want[c].isna() | (got[c] == want[c])).all() for c in cols)
        print("  SAME" if same else "  DIFFERENT", len(want))
        if not same:
            for c in cols:
                if len(want) == len(got):
                    bad = ~(got[c].isna() & want[c].isna() | (got[c] == want[c]))
                    print("  ", c, int(bad.sum()), got[c][bad].head(3).tolist(), want[c][bad].head(3).tolist())
    print(got.head(5).to_string())
