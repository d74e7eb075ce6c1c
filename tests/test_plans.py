"""Plan shape: no Python UDF and no Cartesian product in the headline queries; filters and
column pruning reach the parquet scan."""

from dataclasses import replace

import pytest

from skyops.operators import availability as A
from skyops.plans import reports as R
from skyops.plans import search as S
from skyops.plans.catalog import asof
from skyops.plans.q_availability import requests_of


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["occ", "rev", "hours", "cancel", "fleet", "search", "crew"])
def test_no_udf_no_cartesian(t_small, name):
    t = t_small
    df = {"occ": lambda: R.report_occupancy(t), "rev": lambda: R.report_revenue(t),
          "hours": lambda: R.report_crew_hours(t), "cancel": lambda: R.report_cancel_rate(t),
          "fleet": lambda: R.report_fleet_month(t), "search": lambda: S.flight_search(t, asof()),
          "crew": lambda: A.crew_available(t, requests_of(t))}[name]()
    p = _plan(df)
    assert "PythonUDF" not in p and "ArrowEvalPython" not in p and "BatchEvalPython" not in p
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_scan_prunes_columns(t_small):
    p = _plan(R.report_cancel_rate(t_small))
    # the orders scan reads only what the booking projection needs
    scans = [line.split("ReadSchema: ")[1] for line in p.splitlines() if "ReadSchema: " in line]
    assert scans == ["struct<o_orderkey:bigint,o_orderstatus:string,o_orderdate:timestamp_ntz>"]


def test_filters_reach_the_stored_tables(spark, t_small, tmp_path):
    flight = f"{tmp_path}/flight"
    t_small.flight.write.parquet(flight)
    stored = replace(t_small, flight=spark.read.parquet(flight))
    p = _plan(S.flight_search(stored, asof()))
    assert "PushedFilters: [IsNotNull(dep_ts), GreaterThanOrEqual(dep_ts,2001-01-01T00:00), In(Status, [Active,Full])" in p
