"""Pairs of points and intervals unpacked from arrays."""

import random

import pytest
from pyspark.sql import functions as F

from skyops.operators import availability as A
from skyops.operators import intervals as I
from skyops.plans import catalog
from skyops.plans.q_availability import requests_of


@pytest.mark.parametrize("packed", [1, 3, 1000])
def test_packed_pairs_are_the_pairs(spark, monkeypatch, packed):
    """A hot key, repeated rows, nulls, open and empty intervals; instants on the borders."""
    monkeypatch.setattr(I, "PACKED", packed)
    r = random.Random(packed)

    def instant(hours):
        return f"2001-01-{1 + hours // 24:02d} {hours % 24:02d}:{r.choice(['00', '30'])}:00"

    points = [(f"p{i}", r.choice(["a", "a", "b", None]), instant(r.randrange(200))) for i in range(120)]
    spans = []
    for i in range(150):
        lo = r.randrange(200)
        spans.append((i % 140, r.choice(["a", "a", "b", "c", None]), instant(lo), r.choice([None, instant(lo), instant(min(230, lo + r.randrange(60)))])))
    points = spark.createDataFrame(points + points[:5], "rid string, key string, t string").withColumn("t", F.col("t").cast("timestamp_ntz"))
    spans = (spark.createDataFrame(spans + spans[:5], "id int, key string, lo string, hi string")
             .withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("lo", "hi")}))
    got = I.interval_point_pairs(points, spans, ["key"], "t", "lo", "hi").select("rid", "key", "t", "id", "lo", "hi")
    want = points.join(spans, "key").where("lo <= t AND (hi IS NULL OR t < hi)").select("rid", "key", "t", "id", "lo", "hi")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and want.count()
    assert I.interval_point_pairs(points.limit(0), spans, ["key"], "t", "lo", "hi").count() == 0


def test_crew_pairs_keep_their_partitions(spark):
    """Small shuffles with large output are not merged into a few tasks, and pairs come out of arrays."""
    t = catalog.tables(spark, "/root/testdata/sf0.001")
    for made in (A.crew_available(t, requests_of(t)), A.aircraft_available(t, requests_of(t))):
        plan = made._jdf.queryExecution().sparkPlan().toString()
        assert "inline(" in plan and plan.count("REPARTITION_BY_NUM") == 2
