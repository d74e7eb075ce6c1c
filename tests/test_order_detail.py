"""Order lines: tickets met without forming those nobody asks for, and orders met in the shuffle that sorts."""

from dataclasses import replace

from pyspark.sql import functions as F

from skyops.plans import catalog, search
from skyops.sources import airline

SF = "/root/testdata/sf0.001"


def hashed(df):
    return sorted(map(str, df.collect()))


def test_lines_are_formed_once(spark):
    """One read of the links, and no shuffle of tickets on the five columns of a seat."""
    t = catalog.tables(spark, SF)
    plan = search.order_detail(t, catalog.asof())._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("l_linenumber") and sum("lineitem.parquet" in x for x in plan.splitlines()) <= 1
    assert not [x for x in plan.splitlines() if "Join [" in x and "SEAT_Row_num" in x]


def test_links_meet_their_tickets(spark):
    t = catalog.tables(spark, SF)
    flights = t.flight.select(F.col("ID").alias("Flight_ID"), "dep_ts")
    want = t.ticket_order.join(t.ticket.drop("Availability"), search.SEAT5).join(flights, "Flight_ID")
    got = airline.links_with_price(t, t.ticket_order, flights)
    assert hashed(got.select(want.columns)) == hashed(want) and want.count()


def test_stored_tables_and_some_orders(spark):
    """Tables without a derivation give the same lines; only the orders asked for, each as often as it stands in the table."""
    t = catalog.tables(spark, SF)
    whole = search.order_detail(t, catalog.asof())
    assert hashed(search.order_detail(replace(t), catalog.asof())) == hashed(whole)
    some = t.booking.where("ID % 3 = 0")
    assert hashed(search.order_detail(t, catalog.asof(), some)) == hashed(whole.where("Order_ID % 3 = 0"))
    twice = replace(t, booking=some.unionByName(some.withColumn("Status", F.lit(None).cast("string"))))
    lines = search.order_detail(twice, catalog.asof())
    assert lines.where("order_status IS NULL").count() == lines.count() / 2 == whole.where("Order_ID % 3 = 0").count()


def test_lines_are_sorted(spark):
    rows = [(r.Order_ID, r.Flight_ID, r.CLASS_Type, r.SEAT_Row_num, r.SEAT_Column_number) for r in search.order_detail(catalog.tables(spark, SF), catalog.asof()).collect()]
    assert rows == sorted(rows)
