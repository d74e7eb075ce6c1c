"""Registered queries of checkout and of the registration of aircraft, people and crew.

Checkout forms are derived from the customer-cancelled orders (their buyers ask for their seats again, one seat a cart; by remainder of the
order a form fails another check); the other forms are those of the validation queries, with a second form for some keys.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyops.operators import registration as R
from skyops.plans.catalog import AS_OF, asof, query
from skyops.plans.q_booking import REBOOK, SEAT4, rebook_requests
from skyops.plans.q_quality import aircraft_rows, aircrew_rows, people_rows
from skyops.plans.q_reports import hu
from skyops.session import cut_lineage

TS = f"TIMESTAMP '{AS_OF}'"


def checkout_forms(t):
    """(forms, seats): a cart per seat of a customer-cancelled order."""
    k = F.col("order_id") % 9
    letter = F.char(F.lit(65) + F.col("order_id") % 26)
    r = cut_lineage(rebook_requests(t).withColumn("cart_id", F.concat_ws("|", F.col("order_id").cast("string"), *SEAT4.split(", "))))
    forms = r.select(
        "cart_id", "request_ts", "order_id", F.when(F.col("email").startswith("m") & (k != 2), F.col("email")).alias("login"), "email",
        F.when(k == 0, F.lit(" ")).when(k == 3, F.lit("9")).otherwise(F.concat(F.lit(" Ann"), letter)).alias("first"),
        F.when(k == 1, F.lit("Zoë")).otherwise(F.lit("Lee\t")).alias("last"),
        F.when(k == 4, F.concat(F.lit("054"), F.col("email"))).otherwise(F.concat(F.lit("07"), (F.col("order_id") % 100).cast("string"))).alias("phone"))
    return forms, r.select("cart_id", *SEAT4.split(", "))


def _checkout(t):
    return R.checkout(t, *checkout_forms(t), asof())


CHECKOUT = f"""
{REBOOK},
form AS (SELECT p.*, concat_ws('|', order_id, {SEAT4}) AS cart_id, order_id % 9 AS k, f.dep_ts, email IN (SELECT Email FROM member) AS is_member,
                CASE WHEN order_id % 9 = 4 THEN '054' || email ELSE '07' || CAST(order_id % 100 AS VARCHAR) END AS phone
         FROM p LEFT JOIN flight f ON f.ID = p.Flight_ID),
verdict AS (SELECT *, CASE WHEN dep_ts IS NULL THEN 'flight not found' WHEN dep_ts <= {TS} THEN 'departed' WHEN coalesce(Availability, 0) <> 1 THEN 'seat not available' END AS shut,
                   CASE WHEN k = 0 OR email IS NULL THEN 'missing details' WHEN k = 3 THEN 'first name not English' WHEN k = 1 THEN 'last name not English'
                        WHEN k = 2 AND is_member THEN 'member must log in' END AS wrong FROM form),
winner AS (SELECT {SEAT4}, min(ROW(request_ts, order_id)) AS w FROM verdict WHERE shut IS NULL AND wrong IS NULL AND NOT is_held GROUP BY ALL),
answer AS (SELECT v.*, CASE WHEN shut IS NOT NULL THEN shut WHEN ROW(request_ts, order_id) > w THEN 'seat not available' WHEN wrong IS NOT NULL THEN wrong
                            WHEN is_held THEN 'seat held' ELSE 'ok' END AS reason
           FROM verdict v LEFT JOIN winner USING ({SEAT4})),
sale AS (SELECT *, CAST((SELECT coalesce(max(ID), 0) FROM booking) + row_number() OVER (ORDER BY request_ts, order_id, cart_id) AS BIGINT) AS ID FROM answer WHERE reason = 'ok')"""


@query("checkout", f"""
WITH {CHECKOUT}
SELECT a.cart_id, a.request_ts, a.order_id, a.reason, s.ID, {hu('s.Price')} AS Total_price, floor({hu('s.Price')} * 5.0 + 0.5) / 100.0 AS Cancellation_fee
FROM answer a LEFT JOIN sale s USING (cart_id)
""")
def _checkout_outcomes(t):
    return _checkout(t).outcomes


@query("checkout_links", f"""
WITH {CHECKOUT}
SELECT Airplane_ID, Flight_ID, SEAT_Row_num, SEAT_Column_number, CLASS_Type, ID AS Order_ID FROM sale
""")
def _checkout_links(t):
    return _checkout(t).links


@query("checkout_profiles", f"""
WITH {CHECKOUT},
told AS (SELECT is_member, email, order_id, row_number() OVER (PARTITION BY email ORDER BY request_ts DESC, order_id DESC, cart_id DESC) AS back FROM answer WHERE reason IN ('ok', 'seat held'))
SELECT CASE WHEN is_member THEN 'member' ELSE 'guest' END AS kind, email AS Email, 'Ann' || chr(CAST(65 + order_id % 26 AS INTEGER)) AS First_name_in_English,
       'Lee' AS Last_name_in_English, NOT is_member AND email NOT IN (SELECT Email FROM guest) AS is_new
FROM told WHERE back = 1
""")
def _checkout_profiles(t):
    done = _checkout(t)
    return done.members.withColumns({"kind": F.lit("member"), "is_new": F.lit(False)}).unionByName(done.guests.withColumn("kind", F.lit("guest")))


@query("checkout_phones", f"""
WITH {CHECKOUT}
SELECT DISTINCT CASE WHEN is_member THEN 'member' ELSE 'guest' END AS kind, email AS Email, phone AS Phone_number FROM answer WHERE reason IN ('ok', 'seat held')
EXCEPT (SELECT 'member', Email, Phone_number FROM phone_number_member UNION ALL SELECT 'guest', Email, Phone_number FROM phone_number_guest)
""")
def _checkout_phones(t):
    return _checkout(t).phones


def second_aircraft(t):
    rows = aircraft_rows(t)
    return rows.unionByName(rows.where(F.col("airplane_id").endswith("1")).withColumn("manufacturer", F.lit("Airbus")))


# the valid remainders of the supplier key, written out: 10 and 11 are Small, 11 has no rows; a second form of Airbus comes before Boeing
FLEET = """
fresh AS (SELECT s_suppkey + 10000000 AS ID, s_suppkey % 14 AS k FROM supplier WHERE s_suppkey % 14 = 10),
plane AS (SELECT ID, CASE WHEN ID % 10 = 1 THEN 'Airbus' ELSE 'Boeing' END AS Manufacturer, 'Small' AS Size FROM fresh)"""


@query("register_aircraft", f"""
WITH {FLEET}
SELECT ID, CAST('1990-01-01' AS DATE) AS Date_of_purchase, Manufacturer, Size FROM plane
""")
def _register_aircraft(t):
    return R.register_aircraft(second_aircraft(t), t, asof())[1]


@query("register_aircraft_seats", f"""
WITH {FLEET}
SELECT 'Regular' AS Class_Type, ID AS Airplane_ID, CAST(r AS INTEGER) AS Row_num, chr(CAST(64 + c AS INTEGER)) AS Column_number FROM plane, range(1, 8) x(r), range(1, 7) y(c)
""")
def _register_seats(t):
    return R.register_aircraft(second_aircraft(t), t, asof())[3]


@query("register_people", f"""
WITH f AS (SELECT c_custkey AS k, 'm' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, c_mktsegment AS first, regexp_replace(c_name, '[#0-9]', '', 'g') AS last FROM customer),
two AS (SELECT * FROM f UNION ALL SELECT k, email, 'Aa', last FROM f WHERE k % 2 = 0),
ok AS (SELECT k, email, min(first) AS first, min(last) AS last FROM two
       WHERE k % 97 <> 0 AND k % 3 = 0 AND regexp_full_match(trim(first), '[A-Za-z]([A-Za-z ''-]*[A-Za-z])?') AND regexp_full_match(trim(last), '[A-Za-z]([A-Za-z ''-]*[A-Za-z])?')
         AND DATE '1975-01-01' + CAST(k % 10000 AS INTEGER) <= CAST({TS} AS DATE) - INTERVAL 18 YEAR GROUP BY 1, 2)
SELECT email AS Email, trim(first) AS First_name_in_English, trim(last) AS Last_name_in_English, 'P' || CAST(k AS VARCHAR) AS Passport_number,
       CAST(DATE '1975-01-01' + CAST(k % 10000 AS INTEGER) AS DATE) AS Date_of_birth, CAST({TS} AS DATE) AS Register_date, '05' || CAST(k AS VARCHAR) AS Phone_number FROM ok
""")
def _register_people(t):
    rows = people_rows(t)
    again = rows.where(F.substring("passport", 2, 20).cast("long") % 2 == 0).withColumn("first", F.lit("Aa"))
    _, member, phones = R.register_people(rows.unionByName(again), t, asof())
    return member.join(phones, "Email")


@query("register_aircrew", """
WITH k AS (SELECT c_custkey + 10000000 AS ID, c_custkey AS key FROM customer WHERE c_custkey % 12 IN (4, 10, 11))
SELECT ID, 'City' AS City, 'Street' AS Street, 'Ann-Marie' AS First_name, CASE WHEN key % 12 = 4 THEN 'O' ELSE 'O''Neil' END AS Last_name,
       CASE WHEN key % 5 = 0 THEN '049' ELSE '050' END AS Phone_number, 'Pilot' AS Type, '7' AS House_Number, CAST('2001-01-01' AS DATE) AS Start_date_of_employment,
       CASE WHEN key % 2 = 0 THEN 1 ELSE 0 END AS Training
FROM k
""")
def _register_aircrew(t):
    key = F.col("id").try_cast("long")  # null where the id is no number
    rows = aircrew_rows(t).withColumn("training", F.when(key % 2 == 0, F.lit("1")).otherwise(F.lit("")))
    again = rows.where(key % 5 == 0).withColumn("phone", F.lit("049"))
    return R.register_aircrew(rows.unionByName(again), t)[1]

