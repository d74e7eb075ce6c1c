"""Registered booking / lifecycle / generation queries (D-01, D-09 … D-16).

Request tables are derived from the data: re-booking requests are the seats of
customer-cancelled orders (they contend with each other and with held seats), cancel
requests come from the owners of live orders, flight-cancel requests from open flights.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyops.operators import booking as B
from skyops.operators import relational as Rel
from skyops.plans.catalog import AS_OF, asof, query
from skyops.plans.q_reports import hu
from skyops.session import cut_lineage
from skyops.sources.airline import order_links, ts_ntz

TS = f"TIMESTAMP '{AS_OF}'"
REFRESH_AT = "2001-06-01 00:00:00"
SEAT4 = "Flight_ID, CLASS_Type, SEAT_Row_num, SEAT_Column_number"


def rebook_requests(t):
    cancelled = t.booking.where(F.col("Status") == "Customer Cancellation").select(
        F.col("ID").alias("Order_ID"), "Date_of_purchase", F.coalesce("MEMBER_Email", "GUEST_Email").alias("email"))
    return (order_links(t, cancelled.select(F.col("Order_ID").alias("ID"))).join(cancelled, "Order_ID")
            .select(F.col("Date_of_purchase").cast("timestamp_ntz").alias("request_ts"),
                    F.col("Order_ID").alias("order_id"), "email", "Flight_ID", "CLASS_Type", "SEAT_Row_num",
                    "SEAT_Column_number"))


@query("status_refresh_flight", f"""
SELECT ID, CASE WHEN Status IN ('Active', 'Full') AND dep_ts <= TIMESTAMP '{REFRESH_AT}' THEN 'Completed' ELSE Status END AS Status
FROM flight
""")
def _d01f(t):
    f, _ = B.status_refresh(t, ts_ntz(REFRESH_AT))
    return f.select("ID", "Status")


@query("status_refresh_booking", f"""
SELECT ID, CASE WHEN Status = 'Active' AND ID IN (SELECT o.Order_ID FROM ticket_order o JOIN flight f ON f.ID = o.Flight_ID
                                                  WHERE f.dep_ts <= TIMESTAMP '{REFRESH_AT}')
                THEN 'Completed' ELSE Status END AS Status
FROM booking
""")
def _d01b(t):
    _, b = B.status_refresh(t, ts_ntz(REFRESH_AT))
    return b.select("ID", "Status")


REBOOK = f"""
reqs AS (SELECT CAST(b.Date_of_purchase AS TIMESTAMP) AS request_ts, o.Order_ID AS order_id,
                COALESCE(b.MEMBER_Email, b.GUEST_Email) AS email, o.{SEAT4.replace(', ', ', o.')}
         FROM ticket_order o JOIN booking b ON b.ID = o.Order_ID WHERE b.Status = 'Customer Cancellation'),
held AS (SELECT DISTINCT o.{SEAT4.replace(', ', ', o.')} FROM ticket_order o JOIN booking b ON b.ID = o.Order_ID
         WHERE b.Status = 'Active'),
r AS (SELECT q.*, t.Airplane_ID, t.Price, t.Availability, h.Flight_ID IS NOT NULL AS is_held
      FROM reqs q
      LEFT JOIN ticket t ON t.Flight_ID = q.Flight_ID AND t.CLASS_Type = q.CLASS_Type AND t.SEAT_Row_num = q.SEAT_Row_num
                        AND t.SEAT_Column_number = q.SEAT_Column_number
      LEFT JOIN held h ON h.Flight_ID = q.Flight_ID AND h.CLASS_Type = q.CLASS_Type AND h.SEAT_Row_num = q.SEAT_Row_num
                      AND h.SEAT_Column_number = q.SEAT_Column_number),
p AS (SELECT *, CASE WHEN Availability IS NULL THEN 'no such seat' WHEN Availability <> 1 THEN 'unavailable'
                     WHEN is_held THEN 'held' END AS pre FROM r),
ranked AS (SELECT *, CASE WHEN pre IS NULL THEN ROW_NUMBER() OVER (PARTITION BY pre IS NULL, {SEAT4}
                                                                ORDER BY request_ts, order_id) END AS rn FROM p),
adm AS (SELECT request_ts, order_id, email, {SEAT4}, Airplane_ID, Price,
               COALESCE(pre, CASE WHEN rn = 1 THEN 'ok' ELSE 'taken' END) AS reason FROM ranked)"""


@query("seat_admission", f"WITH {REBOOK} SELECT *, reason = 'ok' AS accepted FROM adm")
def _d09(t):
    return B.seat_admission(t, rebook_requests(t)).select(
        "request_ts", "order_id", "email", "Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number",
        "Airplane_ID", "Price", "reason", "accepted")


def rebook_carts(t):
    """Carts by order and flight, with the instant of each seat's row an hour later than the one before it in row order."""
    return rebook_requests(t).withColumn("cart_id", F.concat_ws("|", F.col("order_id").cast("string"), "Flight_ID")) \
        .withColumn("request_ts", F.timestamp_add("HOUR", F.col("SEAT_Row_num"), F.col("request_ts")))


# the carts are folded one after another, in order, over the list of taken seats
CARTS = f"""
{REBOOK},
seat_row AS (SELECT DISTINCT CAST(order_id AS VARCHAR) || '|' || Flight_ID AS cart_id, order_id, email, request_ts + INTERVAL '1' HOUR * CAST(SEAT_Row_num AS INT) AS ts,
                    concat_ws('|', Flight_ID, CLASS_Type, SEAT_Row_num, SEAT_Column_number) AS seat, pre IS NULL AS fine FROM p),
cart AS (SELECT cart_id, min(ts) AS request_ts, min(order_id) AS order_id, min(email) AS email, list(DISTINCT seat) AS seats, bool_and(fine) AS valid FROM seat_row GROUP BY 1),
line AS (SELECT *, row_number() OVER (ORDER BY request_ts, order_id, cart_id) AS n FROM cart WHERE valid),
fold(n, cart_id, accepted, taken) AS (
  SELECT CAST(0 AS BIGINT), '', false, CAST([] AS VARCHAR[])
  UNION ALL
  SELECT l.n, l.cart_id, NOT list_has_any(f.taken, l.seats), CASE WHEN list_has_any(f.taken, l.seats) THEN f.taken ELSE list_concat(f.taken, l.seats) END
  FROM fold f JOIN line l ON l.n = f.n + 1),
decided AS (SELECT c.cart_id, c.request_ts, c.order_id, c.email, c.valid, CAST(len(c.seats) AS BIGINT) AS n_seats, coalesce(f.accepted, false) AS accepted, c.seats
            FROM cart c LEFT JOIN fold f ON f.cart_id = c.cart_id)"""


@query("cart_admission", f"WITH RECURSIVE {CARTS} SELECT cart_id, request_ts, order_id, valid, n_seats, accepted FROM decided")
def _d10(t):
    return B.cart_admission(t, rebook_carts(t))


NEW_ORDERS = f"""
{CARTS},
sold AS (SELECT d.cart_id, d.request_ts, d.order_id, d.email, t.* FROM decided d, unnest(d.seats) u(seat)
         JOIN ticket t ON concat_ws('|', t.Flight_ID, t.CLASS_Type, t.SEAT_Row_num, t.SEAT_Column_number) = u.seat WHERE d.accepted),
paid AS (SELECT cart_id, request_ts, order_id, email, SUM(Price) AS total FROM sold GROUP BY 1, 2, 3, 4),
num AS (SELECT *, CAST((SELECT COALESCE(MAX(ID), 0) FROM booking) + ROW_NUMBER() OVER (ORDER BY request_ts, order_id, cart_id) AS BIGINT) AS ID FROM paid)"""


def _new_orders(t):
    carts = cut_lineage(rebook_carts(t))
    tickets = B.asked_tickets(t, carts)
    won = B.cart_admission(t, carts, tickets).where("accepted").select("cart_id", F.col("request_ts").alias("_ts"), F.col("order_id").alias("_order"))
    lines = carts.join(won, "cart_id").select("cart_id", F.col("_ts").alias("request_ts"), F.col("_order").alias("order_id"), "email", *B.SEAT4).distinct()
    return B.order_create(t, lines, asof(), tickets)


@query("order_create", f"""
WITH RECURSIVE {NEW_ORDERS}
SELECT ID, 'Active' AS Status, {hu('total')} AS Total_price, CAST({TS} AS DATE) AS Date_of_purchase,
       floor({hu('total')} * 5.0 + 0.5) / 100.0 AS Cancellation_fee,
       CASE WHEN email NOT IN (SELECT Email FROM member) THEN email END AS GUEST_Email,
       CASE WHEN email IN (SELECT Email FROM member) THEN email END AS MEMBER_Email
FROM num
""")
def _d11(t):
    return _new_orders(t)[0]


@query("order_create_links", f"""
WITH RECURSIVE {NEW_ORDERS}
SELECT s.Airplane_ID, s.Flight_ID, s.SEAT_Row_num, s.SEAT_Column_number, s.CLASS_Type, n.ID AS Order_ID FROM sold s JOIN num n USING (cart_id)
""")
def _d11l(t):
    return _new_orders(t)[1]


@query("order_create_ticket", f"""
WITH RECURSIVE {NEW_ORDERS}
SELECT Flight_ID, CLASS_Type, SEAT_Row_num, SEAT_Column_number,
       CASE WHEN concat_ws('|', Flight_ID, CLASS_Type, SEAT_Row_num, SEAT_Column_number)
                 IN (SELECT concat_ws('|', Flight_ID, CLASS_Type, SEAT_Row_num, SEAT_Column_number) FROM sold) THEN 0 ELSE Availability END AS Availability
FROM ticket
""")
def _d11t(t):
    return _new_orders(t)[2].select("Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number", "Availability")


CANCEL_REQ = f"""
reqs AS (SELECT {TS} AS request_ts, ID AS order_id, MEMBER_Email AS req_member, GUEST_Email AS req_guest
         FROM booking WHERE Status IN ('Active', 'Completed')),
legs AS (SELECT o.Order_ID, MIN(f.dep_ts) AS first_dep FROM ticket_order o JOIN flight f ON f.ID = o.Flight_ID GROUP BY 1),
outc AS (
  SELECT q.*, CASE WHEN b.ID IS NULL THEN 'not found'
                   WHEN NOT (COALESCE(b.MEMBER_Email = q.req_member, false)
                             OR COALESCE(trim(COALESCE(q.req_guest, '')) <> '' AND b.GUEST_Email = q.req_guest, false))
                     THEN 'not owner'
                   WHEN l.first_dep IS NULL THEN 'no tickets'
                   WHEN date_diff('microsecond', {TS}, l.first_dep) / 3600000000.0 < 36 THEN 'too late'
                   WHEN b.Status <> 'Active' THEN 'not active' ELSE 'ok' END AS reason
  FROM reqs q LEFT JOIN booking b ON b.ID = q.order_id LEFT JOIN legs l ON l.Order_ID = q.order_id)"""


def cancel_requests(t):
    return t.booking.where(F.col("Status").isin("Active", "Completed")).select(
        asof().alias("request_ts"), F.col("ID").alias("order_id"), F.col("MEMBER_Email").alias("req_member"),
        F.col("GUEST_Email").alias("req_guest"))


@query("order_cancel", f"WITH {CANCEL_REQ} SELECT *, reason = 'ok' AS accepted FROM outc")
def _d12(t):
    _, _, out = B.order_cancel(t, cancel_requests(t), asof())
    return out


@query("order_cancel_repeats", f"""
WITH {CANCEL_REQ.replace('reqs AS', 'owners AS').replace('FROM reqs q', 'FROM owners q')},
times(k, who) AS (VALUES (0, 'stranger'), (1, 'owner'), (2, 'owner'), (3, 'stranger'))
SELECT o.request_ts + INTERVAL '1' MINUTE * k AS request_ts, o.order_id, CASE WHEN who = 'owner' THEN o.req_member ELSE 'stranger@example.com' END AS req_member,
       CASE WHEN who = 'owner' THEN o.req_guest END AS req_guest,
       CASE WHEN who = 'stranger' THEN 'not owner' WHEN k = 2 AND o.reason = 'ok' THEN 'not active' ELSE o.reason END AS reason,
       who = 'owner' AND k = 1 AND o.reason = 'ok' AS accepted
FROM outc o, times
""")
def _d12r(t):
    """A stranger asks before and after the owner, who asks twice."""
    own = cancel_requests(t)
    at = lambda df, k: df.withColumn("request_ts", F.timestamp_add("MINUTE", F.lit(k), F.col("request_ts")))
    other = own.withColumn("req_member", F.lit("stranger@example.com")).withColumn("req_guest", F.lit(None).cast("string"))
    return B.order_cancel(t, at(other, 0).unionByName(at(own, 1)).unionByName(at(own, 2)).unionByName(at(other, 3)), asof())[2]


@query("order_cancel_booking", f"""
WITH {CANCEL_REQ}
SELECT b.ID, CASE WHEN o.reason = 'ok' THEN 'Customer Cancellation' ELSE b.Status END AS Status,
       CASE WHEN o.reason = 'ok' THEN (CASE WHEN COALESCE(b.Cancellation_fee, 0) > 0 THEN b.Cancellation_fee
                                            ELSE floor(COALESCE(b.Total_price, 0) * 5.0 + 0.5) / 100.0 END)
            ELSE b.Total_price END AS Total_price
FROM booking b LEFT JOIN outc o ON o.order_id = b.ID
""")
def _d12b(t):
    b, _, _ = B.order_cancel(t, cancel_requests(t), asof())
    return b.select("ID", "Status", "Total_price")


@query("order_cancel_ticket", f"""
WITH {CANCEL_REQ},
newb AS (SELECT b.ID, CASE WHEN o.reason = 'ok' THEN 'Customer Cancellation' ELSE b.Status END AS Status
         FROM booking b LEFT JOIN outc o ON o.order_id = b.ID),
touched AS (SELECT DISTINCT x.Airplane_ID, x.Flight_ID, x.SEAT_Row_num, x.SEAT_Column_number, x.CLASS_Type
            FROM ticket_order x JOIN outc o ON o.order_id = x.Order_ID AND o.reason = 'ok'),
still AS (SELECT DISTINCT x.Airplane_ID, x.Flight_ID, x.SEAT_Row_num, x.SEAT_Column_number, x.CLASS_Type
          FROM ticket_order x JOIN newb b ON b.ID = x.Order_ID WHERE b.Status = 'Active')
SELECT t.Flight_ID, t.CLASS_Type, t.SEAT_Row_num, t.SEAT_Column_number,
       CASE WHEN u.Flight_ID IS NULL THEN t.Availability WHEN s.Flight_ID IS NOT NULL THEN 0 ELSE 1 END AS Availability
FROM ticket t
LEFT JOIN touched u ON u.Airplane_ID = t.Airplane_ID AND u.Flight_ID = t.Flight_ID AND u.SEAT_Row_num = t.SEAT_Row_num
  AND u.SEAT_Column_number = t.SEAT_Column_number AND u.CLASS_Type = t.CLASS_Type
LEFT JOIN still s ON s.Airplane_ID = t.Airplane_ID AND s.Flight_ID = t.Flight_ID AND s.SEAT_Row_num = t.SEAT_Row_num
  AND s.SEAT_Column_number = t.SEAT_Column_number AND s.CLASS_Type = t.CLASS_Type
""")
def _d12c(t):
    _, tk, _ = B.order_cancel(t, cancel_requests(t), asof())
    return tk.select("Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number", "Availability")


FC = f"""
reqs AS (SELECT ID AS Flight_ID FROM flight WHERE Status IN ('Active', 'Full')),
outc AS (SELECT r.Flight_ID, CASE WHEN f.ID IS NULL THEN 'not found'
                                  WHEN date_diff('microsecond', {TS}, f.dep_ts) / 3600000000.0 < 72 THEN 'too late'
                                  ELSE 'ok' END AS reason
         FROM reqs r LEFT JOIN flight f ON f.ID = r.Flight_ID)"""


def _fc(t):
    req = t.flight.where(F.col("Status").isin("Active", "Full")).select(F.col("ID").alias("Flight_ID"))
    return B.flight_cancel(t, req, asof())


@query("flight_cancel", f"WITH {FC} SELECT * FROM outc")
def _d13(t):
    return _fc(t)[3]


@query("flight_cancel_flight", f"""
WITH {FC} SELECT f.ID, CASE WHEN o.reason = 'ok' THEN 'Canceled' ELSE f.Status END AS Status
FROM flight f LEFT JOIN outc o ON o.Flight_ID = f.ID
""")
def _d13f(t):
    return _fc(t)[0].select("ID", "Status")


@query("flight_cancel_booking", f"""
WITH {FC},
hit AS (SELECT DISTINCT x.Order_ID FROM ticket_order x JOIN outc o ON o.Flight_ID = x.Flight_ID AND o.reason = 'ok')
SELECT b.ID,
       CASE WHEN h.Order_ID IS NOT NULL AND b.Status = 'Active' THEN 'System Cancellation' ELSE b.Status END AS Status,
       CASE WHEN h.Order_ID IS NOT NULL AND b.Status = 'Active' THEN 0.0 ELSE b.Total_price END AS Total_price,
       CASE WHEN h.Order_ID IS NOT NULL AND b.Status = 'Active' THEN 0.0 ELSE b.Cancellation_fee END AS Cancellation_fee
FROM booking b LEFT JOIN hit h ON h.Order_ID = b.ID
""")
def _d13b(t):
    return _fc(t)[1].select("ID", "Status", "Total_price", "Cancellation_fee")


@query("flight_cancel_ticket", f"""
WITH {FC}
SELECT t.Flight_ID, t.CLASS_Type, t.SEAT_Row_num, t.SEAT_Column_number,
       CASE WHEN o.Flight_ID IS NOT NULL THEN 0 ELSE t.Availability END AS Availability
FROM ticket t LEFT JOIN outc o ON o.Flight_ID = t.Flight_ID AND o.reason = 'ok'
""")
def _d13t(t):
    return _fc(t)[2].select("Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number", "Availability")


@query("seat_generate", "SELECT * FROM seat")
def _d14(t):
    return B.seat_generate(t.klass)


def bad_classes(t):
    """The classes, some with 36 columns, some without rows or with unknown ones."""
    k = F.col("Airplane_ID") % 5
    return (t.klass.withColumn("Number_of_columns", F.when(k == 0, F.col("Number_of_columns") * 9).otherwise(F.col("Number_of_columns")).cast("int"))
            .withColumn("Number_of_rows", F.when(k == 1, F.lit(0)).when(k == 2, F.lit(None)).otherwise(F.col("Number_of_rows")).cast("int")))


@query("seat_rejected", """
WITH c AS (SELECT Type, Airplane_ID, CAST(CASE Airplane_ID % 5 WHEN 1 THEN 0 WHEN 2 THEN NULL ELSE Number_of_rows END AS INT) AS Number_of_rows,
                  CAST(CASE WHEN Airplane_ID % 5 = 0 THEN Number_of_columns * 9 ELSE Number_of_columns END AS INT) AS Number_of_columns FROM class)
SELECT Type, Airplane_ID, Number_of_rows, Number_of_columns, CASE WHEN Airplane_ID % 5 = 0 THEN 'too many columns' ELSE 'no rows or columns' END AS reason
FROM c WHERE Airplane_ID % 5 < 3
""")
def _d14r(t):
    return B.seat_rejected(bad_classes(t)).select("Type", "Airplane_ID", "Number_of_rows", "Number_of_columns", "reason")


@query("ticket_generate", """
WITH nf AS (SELECT Flight_ID, Airplane_ID, MIN(CASE WHEN CLASS_Type = 'Regular' THEN Price END) AS price_regular,
                   MIN(CASE WHEN CLASS_Type = 'First' THEN Price END) AS price_first FROM ticket GROUP BY 1, 2)
SELECT n.Airplane_ID, n.Flight_ID, s.Row_num AS SEAT_Row_num, s.Column_number AS SEAT_Column_number, s.Class_Type AS CLASS_Type,
       CASE WHEN s.Class_Type = 'First' THEN COALESCE(n.price_first, n.price_regular) ELSE n.price_regular END AS Price,
       1 AS Availability
FROM nf n JOIN seat s ON s.Airplane_ID = n.Airplane_ID
""")
def _d15(t):
    st = Rel.ticket_stats(t.ticket)
    nf = t.ticket.select("Flight_ID", "Airplane_ID").distinct().join(st, "Flight_ID")
    return B.ticket_generate(nf.select("Flight_ID", "Airplane_ID", "price_regular", "price_first"), t.seat)


@query("flight_plan", """
WITH reqs AS (SELECT dep_ts + INTERVAL 7 DAY AS dep_ts, Origin_airport,
                     CASE WHEN Airplane_ID % 10 = 3 THEN 'NOWHERE' ELSE Arrival_airport END AS Arrival_airport, Airplane_ID FROM flight),
known AS (SELECT q.*, r.Flight_duration AS minutes FROM reqs q LEFT JOIN flight_route r
          ON r.Origin_airport = q.Origin_airport AND r.Arrival_airport = q.Arrival_airport),
last AS (SELECT COALESCE(MAX(TRY_CAST(regexp_extract(ID, '^F([0-9]+)', 1) AS BIGINT)), 0) AS n FROM flight),
numbered AS (SELECT k.*, last.n + ROW_NUMBER() OVER (ORDER BY dep_ts, Origin_airport, Arrival_airport, Airplane_ID) AS k FROM known k, last WHERE minutes IS NOT NULL)
SELECT printf('F%05d', k) AS ID, dep_ts, dep_ts + INTERVAL '1' MINUTE * minutes AS arr_ts, 'Active' AS Status,
       CASE WHEN minutes > 360 THEN 'Long' ELSE 'Short' END AS Type, Airplane_ID, Origin_airport, Arrival_airport, 'ok' AS reason FROM numbered
UNION ALL
SELECT NULL, dep_ts, NULL, NULL, NULL, Airplane_ID, Origin_airport, Arrival_airport, 'no such route' FROM known WHERE minutes IS NULL
""")
def _d16(t):
    to = F.when(F.col("Airplane_ID") % 10 == 3, F.lit("NOWHERE")).otherwise(F.col("Arrival_airport"))
    req = t.flight.select(F.timestamp_add("DAY", F.lit(7), F.col("dep_ts")).alias("dep_ts"), "Origin_airport",
                          to.alias("Arrival_airport"), "Airplane_ID")
    return B.flight_plan(t, req)
