"""Manager reports (R-01 … R-05) and their re-aggregations (R-06 … R-12).

Each report is one lazy plan. Correlated sub-queries of the reference become one
pre-aggregation per fact table followed by equi joins, so every fact table is scanned
once and aggregated partially on the map side before any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyops.functions import exprs as X
from skyops.sources.airline import Airline

# Fixed values of the reports
UTILIZATION_DAYS = 30.0          # report 5 divides active days by a constant 30
CANCEL_THRESHOLD_PCT = 10.0      # months above this rate are flagged
REPORT_TITLES = {
    1: "Average Occupancy of Completed Flights",
    2: "Revenue by Aircraft Size, Manufacturer and Class",
    3: "Accumulated Flight Hours of Employees by Flight Type (Long / Short)",
    4: "Purchase Cancellation Rate by Month",
    5: "Monthly Activity Summary for Each Aircraft in the Fleet",
}


def _seats_per_airplane(t: Airline) -> DataFrame:
    return t.seat.groupBy("Airplane_ID").agg(F.count(F.lit(1)).alias("total_seats"))


# R-01
def report_occupancy(t: Airline) -> DataFrame:
    """Average occupancy % of Completed flights (occupied = links whose order is Completed).

    An aircraft without seats yields a NULL ratio (ignored by AVG); no flight → NULL.
    """
    completed_orders = t.booking.where(F.col("Status") == "Completed").select(F.col("ID").alias("Order_ID"))
    occupied = (t.ticket_order.select("Flight_ID", "Order_ID")
                .join(completed_orders, "Order_ID", "left_semi")
                .groupBy("Flight_ID").agg(F.count(F.lit(1)).alias("occupied_count")))
    flights = (t.flight.where(F.col("Status") == "Completed")
               .select(F.col("ID").alias("Flight_ID"), "Airplane_ID")
               .join(occupied, "Flight_ID", "left")
               .join(_seats_per_airplane(t), "Airplane_ID", "left"))
    ratio = F.try_divide(F.coalesce(F.col("occupied_count"), F.lit(0)).cast("double"),
                         F.coalesce(F.col("total_seats"), F.lit(0)).cast("double"))
    # try_divide by 0.0 gives NULL (SQLite semantics), never an ANSI error
    ratio = F.when(F.coalesce(F.col("total_seats"), F.lit(0)) != 0, ratio)
    return flights.agg(X.half_up(F.avg(ratio) * 100, 6).alias("average_occupancy_percentage"))


# R-02
def report_revenue(t: Airline) -> DataFrame:
    """Income by aircraft size × manufacturer × class over orders Active/Completed."""
    live = t.booking.where(F.col("Status").isin("Active", "Completed")).select(F.col("ID").alias("Order_ID"))
    key = ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"]
    links = t.ticket_order.join(live, "Order_ID", "left_semi").select(*key)
    priced = links.join(t.ticket.select(*key, "Price"), key, "inner")
    # pre-aggregate per aircraft and class before touching the airplane dimension
    per_plane = priced.groupBy("Airplane_ID", "CLASS_Type").agg(F.sum("Price").alias("inc"))
    out = (per_plane.join(t.airplane.select(F.col("ID").alias("Airplane_ID"), "Size", "Manufacturer"),
                          "Airplane_ID", "inner")
           .groupBy("Size", "Manufacturer", "CLASS_Type")
           .agg(X.half_up(F.sum("inc"), 2).alias("Total_Income")))
    return out.orderBy("Size", "Manufacturer", "CLASS_Type")


def qualified_types(aircrew: DataFrame) -> DataFrame:
    """U-01: (crew, 'Short') for everyone ∪ (crew, 'Long') for trained crew."""
    short = aircrew.select(F.col("ID").alias("Aircrew_ID"), F.lit("Short").alias("Flight_Type"))
    long_ = aircrew.where(F.col("Training") == 1).select(F.col("ID").alias("Aircrew_ID"),
                                                         F.lit("Long").alias("Flight_Type"))
    return short.unionByName(long_)


# R-03
def report_crew_hours(t: Airline) -> DataFrame:
    """Hours per crew member per qualified flight type; 0 when none.

    Duration comes from the route table, not from the timestamps.
    """
    legs = (t.flight.where(F.col("Status") == "Completed")
            .select(F.col("ID").alias("Flight_ID"), F.col("Type").alias("Flight_Type"),
                    "Origin_airport", "Arrival_airport")
            .join(F.broadcast(t.flight_route), ["Origin_airport", "Arrival_airport"], "inner"))
    minutes = (t.aircrew_assignment.join(legs, "Flight_ID", "inner")
               .groupBy("Aircrew_ID", "Flight_Type").agg(F.sum("Flight_duration").alias("mins")))
    crew = t.aircrew.select(F.col("ID").alias("Aircrew_ID"), "First_name", "Last_name", "Training")
    out = (qualified_types(crew.withColumnRenamed("Aircrew_ID", "ID"))
           .join(crew, "Aircrew_ID", "inner")
           .join(minutes, ["Aircrew_ID", "Flight_Type"], "left")
           .select(F.col("Aircrew_ID").alias("ID"), "First_name", "Last_name", "Flight_Type",
                   F.coalesce(X.half_up(F.col("mins").cast("double") / 60.0, 2), F.lit(0.0))
                   .alias("Total_Flight_Hours")))
    return out.orderBy("Last_name", "First_name", "Flight_Type", "ID")


# R-04
def report_cancel_rate(t: Airline) -> DataFrame:
    """Customer-cancellation % by purchase month (``YYYY/MM``); the denominator is every order."""
    return (t.booking.groupBy(X.month_slash("Date_of_purchase").alias("Month"))
            .agg(X.half_up(F.count_if(F.col("Status") == "Customer Cancellation").cast("double")
                           / F.count(F.lit(1)) * 100, 2).alias("Cancellation_Rate"))
            .orderBy("Month"))


def route_ranking(flight: DataFrame) -> DataFrame:
    """W-01: routes of Completed flights per (aircraft, month) ranked by count desc, route asc."""
    counts = (flight.where(F.col("Status") == "Completed")
              .groupBy("Airplane_ID", X.month_dash("dep_ts").alias("Month"),
                       X.route_label("Origin_airport", "Arrival_airport").alias("Route"))
              .agg(F.count(F.lit(1)).alias("Route_Count")))
    w = Window.partitionBy("Airplane_ID", "Month").orderBy(F.desc("Route_Count"), F.asc("Route"))
    return counts.withColumn("rn", F.row_number().over(w))


def monthly_stats(flight: DataFrame) -> DataFrame:
    done = F.col("Status") == "Completed"
    return (flight.groupBy("Airplane_ID", X.month_dash("dep_ts").alias("Month"))
            .agg(F.count_if(done).alias("Flights_Executed"),
                 F.count_if(F.col("Status") == "Canceled").alias("Flights_Canceled"),
                 F.count_distinct(F.when(done, X.day("dep_ts"))).alias("Active_Days")))


# R-05
def report_fleet_month(t: Airline) -> DataFrame:
    """Per aircraft-month: executed, canceled, utilization (active days / 30), dominant route.

    Two chained hash aggregates and one pass over the flights: per (aircraft, month, route)
    the completed / cancelled counts and the set of active days (≤ 31 per month, so bounded),
    then per (aircraft, month) the sums, the distinct active days and the dominant route as
    ``min`` of ``(-count, route)`` over routes with a completed flight. No COUNT DISTINCT
    expansion of the fact rows, no window, no join.
    """
    done = F.col("Status") == "Completed"
    per_route = (t.flight.groupBy("Airplane_ID", X.month_dash("dep_ts").alias("Month"),
                                  X.route_label("Origin_airport", "Arrival_airport").alias("Route"))
                 .agg(F.count_if(done).alias("n"), F.count_if(F.col("Status") == "Canceled").alias("c"),
                      F.collect_set(F.when(done, X.day("dep_ts"))).alias("days")))
    best = F.min(F.when(F.col("n") > 0, F.struct((-F.col("n")).alias("neg"), F.col("Route").alias("r"))))
    out = (per_route.groupBy("Airplane_ID", "Month")
           .agg(F.sum("n").alias("Flights_Executed"), F.sum("c").alias("Flights_Canceled"),
                F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("Active_Days"), best.alias("best"))
           .select("Airplane_ID", "Month",
                   F.col("Flights_Executed").cast("long").alias("Flights_Executed"),
                   F.col("Flights_Canceled").cast("long").alias("Flights_Canceled"),
                   X.half_up(F.col("Active_Days") / F.lit(UTILIZATION_DAYS) * 100, 2).alias("Utilization_Percentage"),
                   F.col("best.r").alias("Dominant_Route")))
    return out.orderBy("Month", "Airplane_ID")


REPORTS = {1: report_occupancy, 2: report_revenue, 3: report_crew_hours, 4: report_cancel_rate,
           5: report_fleet_month}


def run_report(t: Airline, rid) -> DataFrame:
    """S-04: report by id; an unknown id falls back to report 1."""
    try:
        rid = int(rid)
    except (TypeError, ValueError):
        rid = 1
    return REPORTS.get(rid, report_occupancy)(t)


def _labels(spark, names: list[str], col: str) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias(col))


# R-06
def revenue_leaders(report2: DataFrame) -> DataFrame:
    """Best manufacturer for Regular, First (best single row) and overall (manufacturer sum).

    Empty categories give ``N/A`` / 0. Ties → smallest manufacturer (then size).
    """
    per_class = (report2.where(F.lower("CLASS_Type").isin("regular", "first"))
                 .groupBy(F.lower("CLASS_Type").alias("Category"))
                 .agg(F.min(F.struct((-F.col("Total_Income")).alias("k"), F.col("Manufacturer").alias("m"),
                                     F.col("Size").alias("s"))).alias("b"))
                 .select("Category", F.col("b.m").alias("Manufacturer"), (-F.col("b.k")).alias("Total_Income")))
    overall = (report2.groupBy("Manufacturer").agg(F.sum("Total_Income").alias("inc"))
               .agg(F.min(F.struct((-X.half_up("inc", 2)).alias("k"), F.col("Manufacturer").alias("m"))).alias("b"))
               .where(F.col("b").isNotNull())
               .select(F.lit("overall").alias("Category"), F.col("b.m").alias("Manufacturer"),
                       (-F.col("b.k")).alias("Total_Income")))
    cats = _labels(report2.sparkSession, ["regular", "first", "overall"], "Category")
    return (cats.join(per_class.unionByName(overall), "Category", "left")
            .select("Category", F.coalesce("Manufacturer", F.lit("N/A")).alias("Manufacturer"),
                    F.coalesce("Total_Income", F.lit(0.0)).alias("Total_Income")))


def _extremes(df: DataFrame, measure: str, key_cols: list[str], label: str, by: list[str] | None = None) -> DataFrame:
    """A-13: max and min row of ``measure`` (ties → smallest key), optionally per ``by``."""
    by = by or []
    payload = [F.col(c).alias(c) for c in key_cols]
    hi = F.min(F.struct((-F.col(measure)).alias("k"), *payload)).alias("hi")
    lo = F.min(F.struct(F.col(measure).alias("k"), *payload)).alias("lo")
    agg = df.groupBy(*by).agg(hi, lo) if by else df.agg(hi, lo)
    agg = agg.where(F.col("hi").isNotNull())
    mx = agg.select(*by, F.lit("max").alias(label), *[F.col(f"hi.{c}").alias(c) for c in key_cols],
                    (-F.col("hi.k")).alias(measure))
    mn = agg.select(*by, F.lit("min").alias(label), *[F.col(f"lo.{c}").alias(c) for c in key_cols],
                    F.col("lo.k").alias(measure))
    return mx.unionByName(mn)


def extremes(df: DataFrame, measure: str, key: str, by: str | None = None) -> DataFrame:
    """A-13 public form: rows ``(by?, Extreme ∈ {max, min}, key, measure)``."""
    return _extremes(df, measure, [key], "Extreme", [by] if by else None)


# R-07
def crew_hours_extremes(report3: DataFrame) -> DataFrame:
    """Max / min hours overall (sum of a member's rows), for Long and for Short."""
    named = report3.select("ID", F.trim(F.concat_ws(" ", F.trim(F.col("First_name").cast("string")),
                                                         F.trim(F.col("Last_name").cast("string")))).alias("Name"),
                           "Flight_Type", F.coalesce("Total_Flight_Hours", F.lit(0.0)).alias("Hours"))
    overall = (named.groupBy("ID", "Name").agg(X.half_up(F.sum("Hours"), 2).alias("Hours"))
               .withColumn("Scope", F.lit("overall")))
    typed = named.select("ID", "Name", "Hours", F.lower("Flight_Type").alias("Scope")) \
                 .where(F.col("Scope").isin("long", "short"))
    both = overall.unionByName(typed)
    return _extremes(both, "Hours", ["ID", "Name"], "Extreme", ["Scope"])


# R-08
def cancel_extremes(report4: DataFrame) -> DataFrame:
    """Months with the lowest and highest cancellation rate (ties → earliest month)."""
    return _extremes(report4.select("Month", F.coalesce("Cancellation_Rate", F.lit(0.0)).alias("Cancellation_Rate")),
                     "Cancellation_Rate", ["Month"], "Extreme")


# O-05
def pick_month(report: DataFrame, as_of: Column) -> DataFrame:
    """The as_of month (``YYYY-MM``) if present, else the latest month: one-row frame."""
    cur = X.month_dash(as_of)
    return report.agg(F.coalesce(F.max(F.when(F.col("Month") == cur, F.col("Month"))), F.max("Month"))
                      .alias("Month")).where(F.col("Month").isNotNull())


# R-09
def fleet_extremes(report5: DataFrame, as_of: Column) -> DataFrame:
    """In the chosen month: aircraft with max/min utilization and max/min executed flights."""
    month = pick_month(report5, as_of)
    rows = report5.join(month, "Month", "left_semi")
    util = _extremes(rows.select("Month", "Airplane_ID", F.col("Utilization_Percentage").alias("Value")),
                     "Value", ["Airplane_ID"], "Extreme", ["Month"]).withColumn("Measure", F.lit("utilization"))
    flights = _extremes(rows.select("Month", "Airplane_ID", F.col("Flights_Executed").cast("double").alias("Value")),
                        "Value", ["Airplane_ID"], "Extreme", ["Month"]).withColumn("Measure", F.lit("flights"))
    return util.unionByName(flights)


# R-10 / A-14
def revenue_chart(report2: DataFrame) -> DataFrame:
    """Plane label × class matrix of income, missing = 0, sorted by label."""
    return (report2.withColumn("Plane", X.plane_label("Manufacturer", "Size"))
            .groupBy("Plane").pivot("CLASS_Type", ["First", "Regular"]).agg(F.sum("Total_Income"))
            .fillna(0.0, subset=["First", "Regular"])
            .select("Plane", X.half_up("First", 2).alias("First"), X.half_up("Regular", 2).alias("Regular"))
            .orderBy("Plane"))


# R-11
def cancel_trend(report4: DataFrame, threshold: float = CANCEL_THRESHOLD_PCT) -> DataFrame:
    """Chart rows: month, rate (NULL → 0) and whether the rate is above the threshold."""
    rate = F.coalesce(F.col("Cancellation_Rate"), F.lit(0.0))
    return report4.select("Month", rate.alias("Rate"), (rate > F.lit(threshold)).alias("Above_Threshold")) \
                  .orderBy("Month")


# A-17
def rate_summary(report4: DataFrame, threshold: float = CANCEL_THRESHOLD_PCT) -> DataFrame:
    """Executive summary of the cancellation report as one row: mean rate, peak month and rate,
    months above the threshold (comma list, NULL when none)."""
    rate = F.coalesce(F.col("Cancellation_Rate"), F.lit(0.0))
    peak = F.min(F.struct((-rate).alias("k"), F.col("Month").alias("m")))
    above = F.array_sort(F.collect_list(F.when(rate > F.lit(threshold), F.col("Month"))))
    return report4.agg(X.half_up(F.avg(rate), 2).alias("Avg_Rate"), peak.alias("p"), above.alias("a")) \
        .select("Avg_Rate", F.col("p.m").alias("Peak_Month"), (-F.col("p.k")).alias("Peak_Rate"),
                F.when(F.size("a") > 0, F.array_join("a", ", ")).alias("Months_Above"))


# A-18
def revenue_summary(report2: DataFrame) -> DataFrame:
    """Grand total, most profitable category and top manufacturer, one row."""
    top = F.min(F.struct((-F.col("Total_Income")).alias("k"), F.col("Manufacturer").alias("m"),
                         F.col("Size").alias("s"), F.col("CLASS_Type").alias("c")))
    by_man = report2.groupBy("Manufacturer").agg(X.half_up(F.sum("Total_Income"), 2).alias("inc"))
    best_man = by_man.agg(F.min(F.struct((-F.col("inc")).alias("k"), F.col("Manufacturer").alias("m"))).alias("bm"))
    main = report2.agg(X.half_up(F.sum("Total_Income"), 2).alias("Total_Revenue"), top.alias("t"))
    # the manufacturer leader enters as a scalar sub-query of a one-row aggregate
    return (main.withColumn("bm", best_man.select("bm").scalar())
            .select("Total_Revenue", F.col("t.m").alias("Top_Manufacturer_Row"), F.col("t.s").alias("Top_Size"),
                    F.col("t.c").alias("Top_Class"), (-F.col("t.k")).alias("Top_Income"),
                    F.col("bm.m").alias("Top_Manufacturer"), (-F.col("bm.k")).alias("Top_Manufacturer_Income")))


# R-12 / J-15
def dashboard(t: Airline) -> DataFrame:
    """Counts of flights, orders, aircrew, airplanes and the occupancy of report 1 (one row)."""
    def n(df: DataFrame) -> Column:
        return df.select(F.count(F.lit(1))).scalar()

    occ = report_occupancy(t)
    return occ.select(n(t.flight).alias("flights"), n(t.booking).alias("orders"),
                      n(t.aircrew).alias("aircrew"), n(t.airplane).alias("airplanes"),
                      "average_occupancy_percentage")
