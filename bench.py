"""Benchmark the headline queries (R-01 … R-05, Q-01, D-03) and the heavy ones (D-06 to D-08, D-10) and print ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Steps:
1. ``ingest`` — derive the airline tables from the driver tables and write them once as
   parquet (``flight``/``ticket``/``ticket_order`` clustered by flight id) under the session's
   checkpoint directory; this is the storage the reference keeps in its database file.
2. each query runs over the stored tables and is executed in full with the ``noop`` sink
   (no collect); the best of ``BENCH_REPEAT`` runs is reported (one run for the heavy ones).

``value`` is ingest + the sum of the query times.
"""

from __future__ import annotations

import json
import os
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyops.session import ensure_checkpoint_dir, get_spark  # noqa: E402
from skyops.sources import airline  # noqa: E402


def _run(df) -> float:
    t0 = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def _run_built(build) -> float:
    """Building counts too: some plans run rounds before they return."""
    t0 = time.perf_counter()
    _run(build())
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(2 * cpus, 8), app_name="skyops-bench")
    ckpt = ensure_checkpoint_dir(spark)
    store = os.path.join(ckpt, f"bench-tables-{uuid.uuid4().hex[:8]}")

    from skyops.operators import availability as A
    from skyops.operators import booking as B
    from skyops.plans import reports as R
    from skyops.plans import search as S
    from skyops.plans.catalog import asof
    from skyops.plans.q_availability import requests_of
    from skyops.plans.q_booking import rebook_carts

    t0 = time.perf_counter()
    airline.materialize(airline.derive(spark, sf_dir), store)
    ingest = time.perf_counter() - t0
    t = airline.load(spark, store)
    t.sf_dir = sf_dir

    plans = {
        "report_occupancy": lambda: R.report_occupancy(t),
        "report_revenue": lambda: R.report_revenue(t),
        "report_crew_hours": lambda: R.report_crew_hours(t),
        "report_cancel_rate": lambda: R.report_cancel_rate(t),
        "report_fleet_month": lambda: R.report_fleet_month(t),
        "flight_search": lambda: S.flight_search(t, asof()),
        "crew_available": lambda: A.crew_available(t, requests_of(t)),
    }
    heavy = {
        "feasibility": lambda: A.feasibility(t, requests_of(t)),
        "earliest_slot": lambda: A.earliest_slot(t, requests_of(t)),
        "crew_recommend": lambda: A.crew_recommend(t, requests_of(t)),
        "cart_admission": lambda: B.cart_admission(t, rebook_carts(t)),
    }
    times = {"ingest": round(ingest, 3)}
    for name, build in (plans | heavy).items():
        best = min(_run_built(build) for _ in range(1 if name in heavy else repeat))
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_total_sec", "value": total, "unit": "sec", "queries": times,
                      "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
