"""Report registry and requirement rules."""

from skyops.operators import availability as A
from skyops.plans import reports as R


def test_registry_falls_back_to_report_1(t_small):
    assert R.run_report(t_small, "9").columns == ["average_occupancy_percentage"]
    assert R.run_report(t_small, "x").columns == ["average_occupancy_percentage"]
    assert R.run_report(t_small, 4).columns == ["Month", "Cancellation_Rate"]


def test_crew_requirement_by_type_and_size(spark):
    df = spark.createDataFrame([("Long", "Big"), ("Short", "Small"), ("Short", "Big")], "flight_type string, Size string")
    by_type = [(r.need_size, r.need_training, r.req_pilots, r.req_attendants)
               for r in A.crew_requirement(df, "type").collect()]
    assert by_type == [("Big", True, 3, 6), (None, False, 2, 3), (None, False, 2, 3)]
    by_size = [(r.req_pilots, r.req_attendants) for r in A.crew_requirement(df, "size").collect()]
    assert by_size == [(3, 6), (2, 3), (3, 6)]


def test_revenue_leaders_empty_is_na(spark, t_small):
    empty = R.report_revenue(t_small).limit(0)
    rows = {r.Category: (r.Manufacturer, r.Total_Income) for r in R.revenue_leaders(empty).collect()}
    assert rows == {"regular": ("N/A", 0.0), "first": ("N/A", 0.0), "overall": ("N/A", 0.0)}
