"""Print the physical-plan shape of the headline queries over stored tables: exchanges,
broadcasts, join strategies, windows, Python UDFs and the filters pushed into each scan.

    python tools/plan_audit.py [--sf /root/testdata/sf0.01] [--formatted name]
"""

from __future__ import annotations

import argparse
import os
import re
import sys
import uuid

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def main() -> None:
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.01")
    ap.add_argument("--formatted", default=None, help="also print explain('formatted') of this query")
    a = ap.parse_args()
    from skyops.operators import availability as A
    from skyops.plans import reports as R
    from skyops.plans import search as S
    from skyops.plans.catalog import asof
    from skyops.plans.q_availability import requests_of
    from skyops.session import ensure_checkpoint_dir, get_spark
    from skyops.sources import airline

    spark = get_spark("local[8]", 16)
    store = os.path.join(ensure_checkpoint_dir(spark), "audit-" + uuid.uuid4().hex[:6])
    airline.materialize(airline.derive(spark, a.sf), store)
    t = airline.load(spark, store)
    t.sf_dir = a.sf
    plans = {"report_occupancy": R.report_occupancy(t), "report_revenue": R.report_revenue(t),
             "report_crew_hours": R.report_crew_hours(t), "report_cancel_rate": R.report_cancel_rate(t),
             "report_fleet_month": R.report_fleet_month(t), "flight_search": S.flight_search(t, asof()),
             "crew_available": A.crew_available(t, requests_of(t)), "feasibility": A.feasibility(t, requests_of(t))}
    for name, df in plans.items():
        p = df._jdf.queryExecution().executedPlan().toString()
        counts = {k: p.count(v) for k, v in {
            "shuffle": "Exchange hashpartitioning", "range": "Exchange rangepartitioning",
            "single": "Exchange SinglePartition", "broadcast": "BroadcastExchange", "smj": "SortMergeJoin",
            "bhj": "BroadcastHashJoin", "bnlj": "BroadcastNestedLoopJoin", "cartesian": "CartesianProduct",
            "window": "Window [", "python_udf": "PythonUDF"}.items()}
        print(f"== {name}: " + " ".join(f"{k}={v}" for k, v in counts.items()))
        for cols, pf in re.findall(r"FileScan parquet \[([^\]]*)\].*?PushedFilters: \[([^\]]*)\]", p):
            print(f"   scan [{cols[:70]}] pushed [{pf[:100]}]")
        if a.formatted == name:
            df.explain("formatted")


if __name__ == "__main__":
    main()
