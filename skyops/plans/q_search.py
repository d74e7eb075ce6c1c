"""Registered search / order-list queries Q-01 … Q-12."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyops.plans import search as S
from skyops.plans.catalog import AS_OF, asof, query
from skyops.plans.q_reports import SOLD

TS = f"TIMESTAMP '{AS_OF}'"

STATS = f"""
SELECT f.*, a.Manufacturer, a.Size, price_regular, price_first, coalesce(total_tickets, 0) AS total_tickets, coalesce(available_tickets, 0) AS available_tickets
FROM (WITH {SOLD} SELECT * FROM sold) s RIGHT JOIN flight f ON s.Flight_ID = f.ID JOIN airplane a ON a.ID = f.Airplane_ID
WHERE f.Status IN ('Active', 'Full') AND f.dep_ts >= {{ts}}{{extra}}"""

COLS = ["ID", "dep_ts", "arr_ts", "Status", "Type", "Airplane_ID", "Origin_airport", "Arrival_airport", "Manufacturer",
        "Size", "price_regular", "price_first", "total_tickets", "available_tickets"]


@query("flight_search", f"""
SELECT * FROM ({STATS.format(ts=TS, extra='')} ORDER BY f.dep_ts, f.ID LIMIT 200) x WHERE available_tickets > 0
""")
def _q01(t):
    return S.flight_search(t, asof()).select(*COLS)


@query("flight_search_route", f"""
SELECT * FROM ({STATS.format(ts=TS, extra=" AND f.Origin_airport = 'NATION_4'")} ORDER BY f.dep_ts, f.ID LIMIT 200) x
WHERE available_tickets > 0
""")
def _q01b(t):
    return S.flight_search(t, asof(), origin=" nation_4 ").select(*COLS)


@query("flight_results", f"""
SELECT *, COALESCE(Status IN ('Active', 'Full') AND available_tickets > 0, false) AS sellable
FROM ({STATS.format(ts=TS, extra='')}) x
""")
def _q02(t):
    return S.flight_results(t, asof()).select(*COLS, "sellable")


@query("route_origins", """
SELECT DISTINCT r.Origin_airport AS code, COALESCE(a.Label, r.Origin_airport) AS label
FROM flight_route r LEFT JOIN airport a ON a.Code = r.Origin_airport
""")
def _q03a(t):
    return S.route_origins(t).select("code", "label")


@query("route_destinations", """
SELECT DISTINCT r.Arrival_airport AS code, COALESCE(a.Label, r.Arrival_airport) AS label
FROM flight_route r LEFT JOIN airport a ON a.Code = r.Arrival_airport WHERE r.Origin_airport = 'NATION_3'
""")
def _q03b(t):
    return S.route_destinations(t, "nation_3").select("code", "label")


@query("available_dates", f"""
SELECT DISTINCT Origin_airport, Arrival_airport, CAST(dep_ts AS DATE) AS d FROM flight
WHERE Status IN ('Active', 'Full') AND dep_ts >= {TS}
""")
def _q04(t):
    return S.available_dates(t, asof())


ROLLUP_JOINS = """
FROM booking o
LEFT JOIN ticket_order x ON x.Order_ID = o.ID
LEFT JOIN ticket t ON t.Airplane_ID = x.Airplane_ID AND t.Flight_ID = x.Flight_ID AND t.SEAT_Row_num = x.SEAT_Row_num
 AND t.SEAT_Column_number = x.SEAT_Column_number AND t.CLASS_Type = x.CLASS_Type
LEFT JOIN flight f ON f.ID = t.Flight_ID"""


@query("member_orders", f"""
SELECT o.MEMBER_Email, o.ID, o.Status, o.Total_price, o.Date_of_purchase, COUNT(x.Order_ID) AS tickets_count,
       MIN(CAST(f.dep_ts AS DATE)) AS dep_date, MIN(strftime(f.dep_ts, '%H:%M')) AS dep_time,
       MIN(f.Origin_airport) AS origin, MIN(f.Arrival_airport) AS dest
{ROLLUP_JOINS}
WHERE o.MEMBER_Email IS NOT NULL
GROUP BY o.MEMBER_Email, o.ID, o.Status, o.Total_price, o.Date_of_purchase
""")
def _q05(t):
    return S.member_orders(t)


@query("order_detail", f"""
WITH lines AS (
  SELECT x.Order_ID, t.CLASS_Type, t.SEAT_Row_num, t.SEAT_Column_number, t.Price, t.Flight_ID, f.dep_ts,
         f.Origin_airport, f.Arrival_airport, f.Status AS flight_status
  FROM ticket_order x
  JOIN ticket t ON t.Airplane_ID = x.Airplane_ID AND t.Flight_ID = x.Flight_ID AND t.SEAT_Row_num = x.SEAT_Row_num
   AND t.SEAT_Column_number = x.SEAT_Column_number AND t.CLASS_Type = x.CLASS_Type
  JOIN flight f ON f.ID = t.Flight_ID),
firstleg AS (SELECT Order_ID, MIN(dep_ts) AS dep_ts FROM lines GROUP BY 1),
elig AS (
  SELECT b.ID AS Order_ID, b.Status AS order_status, date_diff('microsecond', {TS}, fl.dep_ts) / 3600000000.0 AS hrs,
         fl.Order_ID IS NOT NULL AS has_lines
  FROM booking b LEFT JOIN firstleg fl ON fl.Order_ID = b.ID)
SELECT l.*, e.order_status, COALESCE(e.order_status = 'Active' AND e.hrs >= 36, false) AS can_cancel,
       CASE WHEN e.order_status <> 'Active' THEN 'not active'
            WHEN e.has_lines AND e.hrs < 36 THEN 'too late' END
         AS cancel_reason
FROM lines l JOIN elig e ON e.Order_ID = l.Order_ID
""")
def _q06(t):
    return S.order_detail(t, asof())


@query("order_search", f"""
SELECT o.ID, o.Status, o.Total_price, o.Date_of_purchase, o.MEMBER_Email, o.GUEST_Email,
       COUNT(x.Order_ID) AS tickets_count, MIN(t.Flight_ID) AS flight_id,
       MIN(CAST(f.dep_ts AS DATE)) AS dep_date, MIN(strftime(f.dep_ts, '%H:%M')) AS dep_time,
       MIN(f.Origin_airport) AS origin, MIN(f.Arrival_airport) AS dest
{ROLLUP_JOINS}
WHERE 1 = 1 AND o.Status = 'Active'
  AND (CAST(o.ID AS VARCHAR) ILIKE '%12%' OR o.MEMBER_Email ILIKE '%12%' OR o.GUEST_Email ILIKE '%12%')
GROUP BY o.ID, o.Status, o.Total_price, o.Date_of_purchase, o.MEMBER_Email, o.GUEST_Email
""")
def _q07(t):
    return S.order_search(t, status="Active", q="12")


@query("flight_roster", f"""
WITH {SOLD},
named AS (SELECT Flight_ID, c.ID, c.Type, printf('%s %s (#%d)', First_name, Last_name, CAST(c.ID AS BIGINT)) AS who FROM aircrew_assignment JOIN aircrew c ON c.ID = Aircrew_ID),
crew AS (SELECT Flight_ID, string_agg(who, ', ' ORDER BY ID) FILTER (Type = 'Pilot') AS pilots,
                string_agg(who, ', ' ORDER BY ID) FILTER (Type = 'Flight attendant') AS attendants FROM named GROUP BY 1)
SELECT f.ID, dep_ts, Status, arr_ts, f.Type, f.Airplane_ID, Origin_airport, Arrival_airport, Size, Manufacturer,
       coalesce(total_tickets, 0) AS total_tickets, coalesce(available_tickets, 0) AS available_tickets, pilots, attendants
FROM flight f JOIN airplane a ON a.ID = f.Airplane_ID LEFT JOIN sold ON sold.Flight_ID = f.ID LEFT JOIN crew ON crew.Flight_ID = f.ID
""")
def _q08(t):
    return S.flight_roster(t)


@query("fleet_seats", """
SELECT a.ID, a.Manufacturer, a.Size,
       CAST(COALESCE(SUM(CASE WHEN s.Class_Type = 'Regular' THEN 1 ELSE 0 END), 0) AS BIGINT) AS regular_seats,
       CAST(COALESCE(SUM(CASE WHEN s.Class_Type <> 'Regular' THEN 1 ELSE 0 END), 0) AS BIGINT) AS first_seats,
       COUNT(*) AS total_seats
FROM airplane a LEFT JOIN seat s ON s.Airplane_ID = a.ID GROUP BY a.ID, a.Manufacturer, a.Size
""")
def _q09(t):
    return S.fleet_seats(t)


@query("bookable_check", f"""
SELECT r.Flight_ID,
       CASE WHEN f.ID IS NULL THEN 'not found' WHEN f.dep_ts <= {TS} THEN 'departed'
            WHEN f.Status NOT IN ('Active', 'Full') THEN 'not open'
            WHEN COALESCE((SELECT COUNT(*) FROM ticket t WHERE t.Flight_ID = f.ID AND t.Availability = 1), 0) <= 0 THEN 'sold out'
            ELSE 'ok' END AS reason
FROM (SELECT DISTINCT Flight_ID FROM ticket_order) r LEFT JOIN flight f ON f.ID = r.Flight_ID
""")
def _q10(t):
    return S.bookable_check(t, asof(), t.ticket_order.select("Flight_ID").distinct())


@query("route_list", """
SELECT Origin_airport, Arrival_airport, Flight_duration, CASE WHEN Flight_duration > 360 THEN 'Long' ELSE 'Short' END AS Type
FROM flight_route
""")
def _q11(t):
    return S.route_list(t)


@query("route_lookup", """
SELECT Origin_airport, Arrival_airport, Flight_duration, CASE WHEN Flight_duration > 360 THEN 'Long' ELSE 'Short' END AS Type
FROM flight_route WHERE Origin_airport = 'NATION_2' AND Arrival_airport = 'NATION_7'
""")
def _q11b(t):
    return S.route_list(t, "nation_2 ", " NATION_7")


@query("guest_order_lookup", """
WITH r AS (SELECT CAST(ID AS VARCHAR) AS order_text, COALESCE(GUEST_Email, MEMBER_Email) AS email FROM booking
           UNION ALL SELECT 'x' || CAST(ID AS VARCHAR), GUEST_Email FROM booking WHERE GUEST_Email IS NOT NULL),
p AS (SELECT order_text, email,
             CASE WHEN regexp_full_match(trim(order_text), '[0-9]+') AND TRY_CAST(trim(order_text) AS BIGINT) > 0
                  THEN TRY_CAST(trim(order_text) AS BIGINT) END AS order_id FROM r),
j AS (SELECT p.*, b.GUEST_Email, b.Status,
             CASE WHEN p.order_id IS NULL THEN 'invalid number' WHEN b.Status IS NULL THEN 'not found'
                  WHEN trim(COALESCE(p.email, '')) = '' THEN 'email required'
                  WHEN NOT COALESCE(b.GUEST_Email = trim(p.email), false) THEN 'email mismatch'
                  WHEN b.Status <> 'Active' THEN 'not active' ELSE 'ok' END AS reason
      FROM p LEFT JOIN booking b ON b.ID = p.order_id)
SELECT order_text, email, CASE WHEN reason = 'ok' THEN order_id END AS found_order, reason FROM j
""")
def _q12(t):
    b = t.booking
    req = b.select(F.col("ID").cast("string").alias("order_text"), F.coalesce("GUEST_Email", "MEMBER_Email").alias("email")) \
        .unionByName(b.where(F.col("GUEST_Email").isNotNull())
                     .select(F.concat(F.lit("x"), F.col("ID").cast("string")).alias("order_text"), F.col("GUEST_Email").alias("email")))
    return S.guest_order_lookup(t, req)
