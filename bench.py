"""Time the headline reports and print one JSON line.

``BENCH_SF_DIR`` is the data folder, ``BENCH_CPUS`` the local cores. Each report
runs once to warm up and then ``BENCH_RUNS`` times; the median counts. Results go
to Spark's no-op sink, so every row is computed and none is collected. Raw sheets
are landed in the warm-up run, as in production, and loaded in the timed ones.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from shopledger.session import local_session  # noqa: E402

HEADLINE = [
    "prod_kpis",
    "prod_top_low_efficiency",
    "prod_top_scrap",
    "prod_scrap_by_wc",
    "prod_efficiency_by_employee",
    "prod_run_rate",
    "prod_employees_by_shift",
    "prod_downtime_flatten",
    "prod_downtime_by_reason",
    "plan_compliance",
    "mrp_po_lines",
    "mrp_items_by_type",
    "mrp_requirement_lost",
    "mrp_late_over_30",
    "mrp_filter_options",
    "mrp_compare",
    "ladder_amounts",
    "ladder_by_month",
    "sales_grid",
    "sales_top5",
    "sales_by_customer",
    "sales_by_month",
    "platform_share",
    "purchase_by_vendor",
    "purchase_calendar",
    "purchase_month_type",
    "ladder_long",
    "ladder_table",
]


def run(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeats = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    known = queries()
    times = {}
    for name in names:
        run(spark, known[name], sf_dir)
        times[name] = round(
            statistics.median(run(spark, known[name], sf_dir) for _ in range(repeats)), 3
        )
    print(
        json.dumps(
            {
                "metric": "total_report_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
