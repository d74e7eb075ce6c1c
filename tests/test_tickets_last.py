"""Tickets are formed after the held seats have met their flight, and links of other orders drop out before any join with flights."""

from pyspark.sql import functions as F

from skyops.plans import catalog
from skyops.plans.q_quality import with_broken_rows
from skyops.sources.airline import order_links

SF = "/root/testdata/sf0.001"


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_order_links_are_the_links_of_those_orders(spark):
    t = catalog.tables(spark, SF)
    live = t.booking.where(F.col("Status") == "Active")
    plain = t.ticket_order.join(live.select(F.col("ID").alias("Order_ID")), "Order_ID", "left_semi")
    got = order_links(t, live).select(*plain.columns)
    assert got.count() == plain.count() > 0
    assert got.exceptAll(plain).isEmpty()


def test_a_broken_table_is_derived_once(spark):
    t = catalog.tables(spark, SF)
    # the classes of aircraft are a union themselves; the copies add none
    assert optimized(with_broken_rows(t).ticket).count("Union") == optimized(t.ticket).count("Union")
