"""Sources and sinks that are not driver queries: JDBC options, fail-fast load, append,
summary text, JSON rows."""

import json
import os
import tempfile

import pytest

from skyops.plans import reports as R
from skyops.sources import tables as S


def test_jdbc_options_partitioned():
    o = S.jdbc_options("jdbc:sqlite:/x.db", "FLIGHT", partition_column="rowid", lower=1, upper=1000, num_partitions=8,
                       fetchsize=500)
    assert o == {"url": "jdbc:sqlite:/x.db", "dbtable": "FLIGHT", "partitionColumn": "rowid", "lowerBound": "1",
                 "upperBound": "1000", "numPartitions": "8", "fetchsize": "500"}
    with pytest.raises(ValueError):
        S.jdbc_options("u", "t", partition_column="id")


def test_bulk_load_failfast_and_append(spark):
    d = tempfile.mkdtemp(prefix="skyops-src-", dir="/tmp")
    good = os.path.join(d, "good.csv")
    with open(good, "w") as f:
        f.write("NATION_1,NATION_2,95\nNATION_2,NATION_1,120\n")
    df = S.load(spark, good, "csv", "flight_route")
    assert df.count() == 2 and df.schema["Flight_duration"].dataType.simpleString() == "int"
    bad = os.path.join(d, "bad.csv")
    with open(bad, "w") as f:
        f.write("NATION_1,NATION_2,95\nNATION_3,NATION_4,not-a-number\n")
    with pytest.raises(Exception):
        S.load(spark, bad, "csv", "flight_route").collect()
    out = os.path.join(d, "flight_route")
    S.append(df, out)
    S.append(df, out)
    assert spark.read.parquet(out).count() == 4
    assert S.read_table(spark, d, "flight_route").count() == 4


def test_summary_text_and_json(spark, t_small):
    d = tempfile.mkdtemp(prefix="skyops-sum-", dir="/tmp")
    txt = S.revenue_summary_text(R.revenue_summary(R.report_revenue(t_small)))
    S.write_summary(txt, os.path.join(d, "revenue"))
    lines = spark.read.text(os.path.join(d, "revenue")).collect()
    assert len(lines) == 1 and lines[0].value.startswith("Total revenue: $")
    rows = [json.loads(r.json) for r in S.to_json_rows(t_small.airport, ["Code", "Label"]).collect()]
    assert rows and set(rows[0]) == {"Code", "Label"}
