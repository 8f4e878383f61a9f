"""Benchmark: the eight original analyses at $BENCH_SF_DIR on local[$BENCH_CPUS].

Two measurements, one JSON line:

* ``queries`` (the headline ``value`` is their sum): each analysis runs standalone from the
  raw tables (its own hub materialization, selection passes and final query), the way each
  original statement runs on its own.
* ``report_*``: all eight analyses off one shared hub (``CustomerAnalysis(shared=True)``), the
  way a user produces the whole report; per-analysis times include building whatever shared
  stage it is the first to need.

A warm-up run at the smallest scale absorbs JVM start-up and first code generation; each
timing is the best of ``BENCH_REPEATS`` (default 2) runs, since single runs on a shared host
vary by tens of percent with JIT state and load.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from custseg.plans.analysis import CustomerAnalysis  # noqa: E402
from custseg.plans import registry  # noqa: E402
from custseg.plans.registry import HEADLINE, queries  # noqa: E402
from custseg.session import local_session  # noqa: E402
from custseg.sources.tables import bind_testdata  # noqa: E402

REPORT_METHODS = {
    "q1_customer_segments": lambda a: a.customer_segments(),
    "q2_segment_gmv_share": lambda a: a.segment_gmv_share(),
    "q3_persona_scores": lambda a: a.persona_scores(),
    "q4_top_categories": lambda a: a.top_categories(),
    "q5_hourly_gmv": lambda a: a.hourly_gmv(),
    "q6_repeat_gap_stats": lambda a: a.repeat_gap_stats(),
    "q7_voucher_usage": lambda a: a.voucher_usage(),
    "q8_day_type_performance": lambda a: a.day_type_performance(),
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)))
    registry.FRESH = True            # standalone: no analysis (hub) is shared between queries
    qs = queries()
    for name in HEADLINE.values():                       # warm-up at the smallest scale
        qs[name](spark, "/root/testdata/sf0.001").collect()

    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    timings, rows = {}, {}
    for label, name in HEADLINE.items():
        best = None
        for _ in range(repeats):
            t0 = time.perf_counter()
            rows[label] = len(qs[name](spark, sf_dir).collect())
            took = time.perf_counter() - t0
            best = took if best is None else min(best, took)
            while registry.BUILT:
                registry.BUILT.pop().release()
        timings[label] = round(best, 3)

    report, report_total = {}, None
    for _ in range(repeats):
        run = {}
        t0 = time.perf_counter()
        shared = CustomerAnalysis(bind_testdata(spark, sf_dir), with_vouchers=True, shared=True)
        for label, build in REPORT_METHODS.items():
            t1 = time.perf_counter()
            build(shared).collect()
            run[label] = round(time.perf_counter() - t1, 3)
        total = round(time.perf_counter() - t0, 3)
        shared.release()
        if report_total is None or total < report_total:
            report, report_total = run, total

    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total_sec_8_analyses_standalone",
                      "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "report_total_sec": report_total,
                      "report_queries": report, "rows": rows, "sf": sf, "cpus": cpus,
                      "repeats": repeats}))


if __name__ == "__main__":
    main()
