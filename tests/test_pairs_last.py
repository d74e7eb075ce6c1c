"""Pairs and tickets are formed last: what is shuffled follows the tables, not the pairs (F1, F2) or the seats of all flights."""

import pytest

from skyops.operators import availability as A
from skyops.plans import catalog
from skyops.plans.q_availability import requests_of
from skyops.session import cut_lineage

SF = "/root/testdata/sf0.001"


def joins(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [line for line in plan.splitlines() if "Join " in line]


@pytest.mark.parametrize("name", ["aircraft_available", "crew_available"])
def test_pairs_are_formed_by_one_join(spark, name):
    t = catalog.tables(spark, SF)
    req = cut_lineage(A.crew_requirement(requests_of(t), "type"))
    assert len(joins(getattr(A, name)(t, req))) == 1
