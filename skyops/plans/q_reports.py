"""Registered report queries R-01 … R-12 (+ A-13, A-17, A-18, O-05, W-01, U-01, S-04)."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyops.plans import reports as R
from skyops.plans.catalog import AS_OF, query
from skyops.sources.airline import ts_ntz


def hu(expr: str, n: int = 2) -> str:
    """Oracle text of :func:`skyops.functions.exprs.half_up`."""
    s = f"{float(10 ** n)!r}"
    return f"(floor(({expr}) * {s} + 0.5) / {s})"


SQL_R1 = f"""
WITH capacity AS (SELECT Airplane_ID, COUNT(*) AS seats FROM seat GROUP BY 1),
kept AS (SELECT Flight_ID, COUNT(*) AS used FROM ticket_order SEMI JOIN (SELECT ID FROM booking WHERE Status = 'Completed') done ON done.ID = Order_ID GROUP BY 1),
share AS (SELECT coalesce(used, 0) / CAST(seats AS DOUBLE) AS x FROM flight f JOIN capacity USING (Airplane_ID) LEFT JOIN kept ON Flight_ID = f.ID
          WHERE f.Status = 'Completed')
SELECT {hu("AVG(x) * 100", 6)} AS average_occupancy_percentage FROM share
"""

SQL_R2_BODY = f"""
SELECT Size, Manufacturer, CLASS_Type, {hu("SUM(paid)")} AS Total_Income
FROM (SELECT Airplane_ID, CLASS_Type, SUM(Price) AS paid
      FROM ticket_order JOIN ticket USING (Airplane_ID, Flight_ID, SEAT_Row_num, SEAT_Column_number, CLASS_Type)
      ANTI JOIN (SELECT ID FROM booking WHERE Status LIKE '%Cancellation') void ON void.ID = Order_ID
      GROUP BY 1, 2) JOIN airplane ON airplane.ID = Airplane_ID
GROUP BY ALL
"""

SQL_R3_BODY = f"""
SELECT c.ID, First_name, Last_name, kind AS Flight_Type, {hu("coalesce(minutes, 0) / CAST(60 AS DOUBLE)")} AS Total_Flight_Hours
FROM (SELECT *, unnest(CASE Training WHEN 1 THEN ['Short', 'Long'] ELSE ['Short'] END) AS kind FROM aircrew) c
LEFT JOIN (SELECT Aircrew_ID, Type, SUM(Flight_duration) AS minutes
           FROM flight JOIN flight_route USING (Origin_airport, Arrival_airport) JOIN aircrew_assignment ON Flight_ID = flight.ID
           WHERE Status = 'Completed' GROUP BY 1, 2) worked ON worked.Aircrew_ID = c.ID AND worked.Type = kind
"""

SQL_R4_BODY = f"""
SELECT Month, {hu("CAST(lost AS DOUBLE) / n * 100")} AS Cancellation_Rate
FROM (SELECT strftime(Date_of_purchase, '%Y/%m') AS Month, COUNT(*) AS n, COUNT(*) FILTER (Status = 'Customer Cancellation') AS lost FROM booking GROUP BY 1)
"""

# flights with their month and route, and the route flown most in each month (ties: first by name)
TAGGED = """tagged AS (SELECT *, strftime(dep_ts, '%Y-%m') AS Month, concat(Origin_airport, '-', Arrival_airport) AS Route FROM flight),
per_route AS (SELECT Airplane_ID, Month, Route, COUNT(*) AS n FROM tagged WHERE Status = 'Completed' GROUP BY ALL),
favourite AS (SELECT Airplane_ID, Month, MIN({'k': -n, 'route': Route}).route AS Route FROM per_route GROUP BY ALL)"""

# tickets of a flight: cheapest prices, all and available ones
SOLD = """sold AS (SELECT Flight_ID, MIN(Price) FILTER (CLASS_Type = 'Regular') AS price_regular, MIN(Price) FILTER (CLASS_Type = 'First') AS price_first,
  COUNT(*) AS total_tickets, COUNT(*) FILTER (Availability = 1) AS available_tickets FROM ticket GROUP BY 1)"""

SQL_R5_BODY = f"""
WITH {TAGGED}
SELECT Airplane_ID, Month, COUNT(*) FILTER (Status = 'Completed') AS Flights_Executed, COUNT(*) FILTER (Status = 'Canceled') AS Flights_Canceled,
       {hu("CAST(COUNT(DISTINCT CAST(dep_ts AS DATE)) FILTER (Status = 'Completed') AS DOUBLE) / 30.0 * 100")} AS Utilization_Percentage,
       ANY_VALUE(favourite.Route) AS Dominant_Route
FROM tagged LEFT JOIN favourite USING (Airplane_ID, Month) GROUP BY Airplane_ID, Month
"""


@query("report_occupancy", SQL_R1)
def _r1(t):
    return R.report_occupancy(t)


@query("report_revenue", SQL_R2_BODY)
def _r2(t):
    return R.report_revenue(t)


@query("report_crew_hours", SQL_R3_BODY)
def _r3(t):
    return R.report_crew_hours(t)


@query("report_cancel_rate", SQL_R4_BODY)
def _r4(t):
    return R.report_cancel_rate(t)


@query("report_fleet_month", SQL_R5_BODY)
def _r5(t):
    return R.report_fleet_month(t)


@query("report_registry", SQL_R4_BODY)
def _s04(t):
    # S-04: report 4 by id through the registry
    return R.run_report(t, "4")


@query("row_number_over_agg", f"""
WITH {TAGGED}
SELECT a.Airplane_ID, a.Month, a.Route, a.n AS Route_Count, 1 + COUNT(b.Route) AS rn
FROM per_route a LEFT JOIN per_route b ON b.Airplane_ID = a.Airplane_ID AND b.Month = a.Month AND (b.n > a.n OR (b.n = a.n AND b.Route < a.Route))
GROUP BY ALL
""")
def _w01(t):
    return R.route_ranking(t.flight).withColumn("rn", F.col("rn").cast("long"))


@query("union_all", """
SELECT ID AS Aircrew_ID, unnest(CASE Training WHEN 1 THEN ['Short', 'Long'] ELSE ['Short'] END) AS Flight_Type FROM aircrew
""")
def _u01(t):
    return R.qualified_types(t.aircrew)


@query("revenue_leaders", f"""
WITH r2 AS ({SQL_R2_BODY}),
pc AS (SELECT Category, Manufacturer, Total_Income FROM (
         SELECT lower(CLASS_Type) AS Category, Manufacturer, Total_Income,
                ROW_NUMBER() OVER (PARTITION BY lower(CLASS_Type) ORDER BY Total_Income DESC, Manufacturer, Size) AS rn
         FROM r2 WHERE lower(CLASS_Type) IN ('regular', 'first')) x WHERE rn = 1),
ov AS (SELECT 'overall' AS Category, Manufacturer, inc AS Total_Income FROM (
         SELECT Manufacturer, {hu("SUM(Total_Income)")} AS inc FROM r2 GROUP BY Manufacturer) y
       ORDER BY inc DESC, Manufacturer LIMIT 1),
best AS (SELECT * FROM pc UNION ALL SELECT * FROM ov)
SELECT c.Category, COALESCE(b.Manufacturer, 'N/A') AS Manufacturer, COALESCE(b.Total_Income, 0.0) AS Total_Income
FROM (VALUES ('regular'), ('first'), ('overall')) c(Category) LEFT JOIN best b ON b.Category = c.Category
""")
def _r6(t):
    return R.revenue_leaders(R.report_revenue(t))


@query("crew_hours_extremes", f"""
WITH r3 AS ({SQL_R3_BODY}),
named AS (SELECT ID, trim(concat_ws(' ', trim(First_name), trim(Last_name))) AS Name, Flight_Type,
                 COALESCE(Total_Flight_Hours, 0.0) AS Hours FROM r3),
scoped AS (SELECT ID, Name, {hu("SUM(Hours)")} AS Hours, 'overall' AS Scope FROM named GROUP BY ID, Name
           UNION ALL SELECT ID, Name, Hours, lower(Flight_Type) FROM named WHERE lower(Flight_Type) IN ('long', 'short')),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Scope ORDER BY Hours DESC, ID, Name) AS r_hi,
                     ROW_NUMBER() OVER (PARTITION BY Scope ORDER BY Hours, ID, Name) AS r_lo FROM scoped)
SELECT Scope, 'max' AS Extreme, ID, Name, Hours FROM ranked WHERE r_hi = 1
UNION ALL SELECT Scope, 'min', ID, Name, Hours FROM ranked WHERE r_lo = 1
""")
def _r7(t):
    return R.crew_hours_extremes(R.report_crew_hours(t))


@query("cancel_extremes", f"""
WITH r4 AS ({SQL_R4_BODY}),
ranked AS (SELECT Month, COALESCE(Cancellation_Rate, 0.0) AS Cancellation_Rate,
                  ROW_NUMBER() OVER (ORDER BY COALESCE(Cancellation_Rate, 0.0) DESC, Month) AS r_hi,
                  ROW_NUMBER() OVER (ORDER BY COALESCE(Cancellation_Rate, 0.0), Month) AS r_lo FROM r4)
SELECT 'max' AS Extreme, Month, Cancellation_Rate FROM ranked WHERE r_hi = 1
UNION ALL SELECT 'min', Month, Cancellation_Rate FROM ranked WHERE r_lo = 1
""")
def _r8(t):
    return R.cancel_extremes(R.report_cancel_rate(t))


@query("argmax_argmin", f"""
WITH r4 AS ({SQL_R4_BODY}),
ranked AS (SELECT Month, Cancellation_Rate,
                  ROW_NUMBER() OVER (ORDER BY Cancellation_Rate DESC, Month) AS r_hi,
                  ROW_NUMBER() OVER (ORDER BY Cancellation_Rate, Month) AS r_lo FROM r4)
SELECT 'max' AS Extreme, Month, Cancellation_Rate FROM ranked WHERE r_hi = 1
UNION ALL SELECT 'min', Month, Cancellation_Rate FROM ranked WHERE r_lo = 1
""")
def _a13(t):
    return R.extremes(R.report_cancel_rate(t), "Cancellation_Rate", "Month")


SQL_PICK = f"""
WITH r5 AS ({SQL_R5_BODY}),
m AS (SELECT COALESCE(MAX(CASE WHEN Month = strftime(TIMESTAMP '{AS_OF}', '%Y-%m') THEN Month END), MAX(Month)) AS Month FROM r5)
"""


@query("sorted_months_pick", SQL_PICK + "SELECT Month FROM m WHERE Month IS NOT NULL")
def _o05(t):
    return R.pick_month(R.report_fleet_month(t), ts_ntz(AS_OF))


@query("fleet_extremes", SQL_PICK + """,
rows AS (SELECT r5.* FROM r5 JOIN m ON r5.Month = m.Month),
v AS (SELECT Month, Airplane_ID, Utilization_Percentage AS Value, 'utilization' AS Measure FROM rows
      UNION ALL SELECT Month, Airplane_ID, CAST(Flights_Executed AS DOUBLE), 'flights' FROM rows),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Measure, Month ORDER BY Value DESC, Airplane_ID) AS r_hi,
                     ROW_NUMBER() OVER (PARTITION BY Measure, Month ORDER BY Value, Airplane_ID) AS r_lo FROM v)
SELECT Month, 'max' AS Extreme, Airplane_ID, Value, Measure FROM ranked WHERE r_hi = 1
UNION ALL SELECT Month, 'min', Airplane_ID, Value, Measure FROM ranked WHERE r_lo = 1
""")
def _r9(t):
    return R.fleet_extremes(R.report_fleet_month(t), ts_ntz(AS_OF))


@query("revenue_chart", f"""
WITH r2 AS ({SQL_R2_BODY})
SELECT Manufacturer || ' (' || Size || ')' AS Plane,
       {hu("COALESCE(SUM(CASE WHEN CLASS_Type = 'First' THEN Total_Income END), 0.0)")} AS First,
       {hu("COALESCE(SUM(CASE WHEN CLASS_Type = 'Regular' THEN Total_Income END), 0.0)")} AS Regular
FROM r2 GROUP BY 1
""")
def _r10(t):
    return R.revenue_chart(R.report_revenue(t))


@query("pivot_fill", f"""
WITH r2 AS ({SQL_R2_BODY})
SELECT Manufacturer || ' (' || Size || ')' AS Plane,
       {hu("COALESCE(SUM(CASE WHEN CLASS_Type = 'First' THEN Total_Income END), 0.0)")} AS First,
       {hu("COALESCE(SUM(CASE WHEN CLASS_Type = 'Regular' THEN Total_Income END), 0.0)")} AS Regular
FROM r2 GROUP BY 1
""")
def _a14(t):
    from skyops.operators.relational import pivot_fill
    from skyops.functions import exprs as X
    r2 = R.report_revenue(t).withColumn("Plane", X.plane_label("Manufacturer", "Size"))
    out = pivot_fill(r2, "Plane", "CLASS_Type", "Total_Income", ["First", "Regular"])
    return out.select("Plane", X.half_up("First", 2).alias("First"), X.half_up("Regular", 2).alias("Regular"))


@query("cancel_trend", f"""
WITH r4 AS ({SQL_R4_BODY})
SELECT Month, COALESCE(Cancellation_Rate, 0.0) AS Rate, COALESCE(Cancellation_Rate, 0.0) > 10.0 AS Above_Threshold FROM r4
""")
def _r11(t):
    return R.cancel_trend(R.report_cancel_rate(t))


@query("threshold_list", f"""
WITH r4 AS ({SQL_R4_BODY}),
pk AS (SELECT Month AS Peak_Month, COALESCE(Cancellation_Rate, 0.0) AS Peak_Rate FROM r4
       ORDER BY COALESCE(Cancellation_Rate, 0.0) DESC, Month LIMIT 1)
SELECT {hu("AVG(COALESCE(Cancellation_Rate, 0.0))")} AS Avg_Rate,
       (SELECT Peak_Month FROM pk) AS Peak_Month, (SELECT Peak_Rate FROM pk) AS Peak_Rate,
       string_agg(CASE WHEN COALESCE(Cancellation_Rate, 0.0) > 10.0 THEN Month END, ', ' ORDER BY Month) AS Months_Above
FROM r4
""")
def _a17(t):
    return R.rate_summary(R.report_cancel_rate(t))


@query("revenue_exec_summary", f"""
WITH r2 AS ({SQL_R2_BODY}),
top AS (SELECT * FROM r2 ORDER BY Total_Income DESC, Manufacturer, Size, CLASS_Type LIMIT 1),
bm AS (SELECT Manufacturer, {hu("SUM(Total_Income)")} AS inc FROM r2 GROUP BY Manufacturer ORDER BY inc DESC, Manufacturer LIMIT 1)
SELECT (SELECT {hu("SUM(Total_Income)")} FROM r2) AS Total_Revenue,
       top.Manufacturer AS Top_Manufacturer_Row, top.Size AS Top_Size, top.CLASS_Type AS Top_Class,
       top.Total_Income AS Top_Income, bm.Manufacturer AS Top_Manufacturer, bm.inc AS Top_Manufacturer_Income
FROM top, bm
""")
def _a18(t):
    return R.revenue_summary(R.report_revenue(t))


@query("dashboard_counts", f"""
SELECT (SELECT COUNT(*) FROM flight) AS flights, (SELECT COUNT(*) FROM booking) AS orders,
       (SELECT COUNT(*) FROM aircrew) AS aircrew, (SELECT COUNT(*) FROM airplane) AS airplanes,
       (SELECT average_occupancy_percentage FROM ({SQL_R1}) r1) AS average_occupancy_percentage
""")
def _r12(t):
    return R.dashboard(t)
