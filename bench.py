"""Wall time of the headline queries; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query …]
"""

from __future__ import annotations

import json
import os
import sys
import time

from marginflow.queries import QUERIES
from marginflow.session import local_session

HEADLINE = [
    "service_rollup", "item_day_rollup", "shift_rollup", "weekly_series", "cusum_chart", "ewma_chart", "weekly_comps_drift", "usage_ratio",
    "detect_excess_hours", "detect_price_variance", "detect_usage_drift", "detect_comps_rate", "detect_underpriced_item", "detect_mix_shift",
    "detect_ticket_drift", "qualified_findings", "resolved_overlaps", "build_series", "guardrail_results", "verdicts", "accrual_daily",
    "monthly_accrual", "kpis_by_scope", "funnel", "feed_risk", "queue_cards", "apportion_claims",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "marginflow-bench")
    names = sys.argv[1:] or HEADLINE
    QUERIES["service_rollup"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm the JVM and the file cache
    times = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
