"""Registered queries of flight creation (D-17).

Requests are all flights four weeks later; by remainders of the flight number some lack a price, name an unknown
aircraft or route, or bring too few crew.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from skyops.functions import exprs as X
from skyops.operators.planning import create_flights
from skyops.plans.catalog import query


def _requests(t):
    n = X.flight_no("ID")
    return t.flight.select(
        F.col("ID").alias("rid"), F.timestamp_add("DAY", F.lit(28), F.col("dep_ts")).alias("dep_ts"), "Origin_airport",
        F.when(n % 17 == 0, F.lit("NOWHERE")).otherwise(F.col("Arrival_airport")).alias("Arrival_airport"),
        F.when(n % 13 == 0, F.lit(-1)).otherwise(F.col("Airplane_ID")).cast("long").alias("Airplane_ID"),
        F.when(n % 11 != 0, F.lit(100.0)).alias("price_regular"), F.when(n % 7 != 0, F.lit(300.0)).alias("price_first"))


def _crew(t):
    """Three pilots and six attendants for even flight numbers, two and three for odd ones; one pilot less for every 19th."""
    n = X.flight_no("ID")
    rows = t.flight.select(F.col("ID").alias("rid"), n.alias("n"))
    pilots = F.when(n % 2 == 0, 3).otherwise(2) - F.when(n % 19 == 0, 1).otherwise(0)
    p = t.flight.select(F.col("ID").alias("rid"), n.alias("n"), F.explode(F.sequence(F.lit(1), pilots)).alias("j")).select(
        "rid", F.lit("pilot").alias("role"), (((F.col("n") + F.col("j") * 7) % 40 + 1) * 3).alias("Aircrew_ID"))
    a = rows.select("rid", "n", F.explode(F.sequence(F.lit(1), F.when(F.col("n") % 2 == 0, 6).otherwise(3))).alias("j")).select(
        "rid", F.lit("attendant").alias("role"), ((F.col("n") + F.col("j") * 5) % 40 * 3 + 1).alias("Aircrew_ID"))
    return p.unionByName(a)


CREATED = """
f AS (SELECT *, CAST(substr(ID, 2) AS BIGINT) AS n FROM flight),
wish AS (SELECT n, ID AS rid, dep_ts + INTERVAL 28 DAY AS dep_ts, Origin_airport, CASE WHEN n % 17 = 0 THEN 'NOWHERE' ELSE Arrival_airport END AS Arrival_airport,
                CASE WHEN n % 13 = 0 THEN -1 ELSE Airplane_ID END AS Airplane_ID, CASE WHEN n % 11 <> 0 THEN 100.0 END AS pr, CASE WHEN n % 7 <> 0 THEN 300.0 END AS pf FROM f),
crew AS (SELECT ID AS rid, 'pilot' AS role, ((n + j * 7) % 40 + 1) * 3 AS Aircrew_ID FROM f, range(1, 4) r(j) WHERE j <= 2 + (n % 2 = 0)::INT - (n % 19 = 0)::INT
         UNION ALL SELECT ID, 'attendant', (n + j * 5) % 40 * 3 + 1 FROM f, range(1, 7) r(j) WHERE j <= CASE n % 2 WHEN 0 THEN 6 ELSE 3 END),
staff AS (SELECT rid, count(*) FILTER (role = 'pilot') || '+' || count(*) FILTER (role = 'attendant') AS size, bool_and(coalesce(c.Training, 1) = 1) AS trained
          FROM crew LEFT JOIN aircrew c ON c.ID = Aircrew_ID GROUP BY 1),
seen AS (SELECT w.*, p.Size, r.Flight_duration AS minutes, s.size AS staff, s.trained, w.Airplane_ID IN (SELECT Airplane_ID FROM seat) AS seated
         FROM wish w LEFT JOIN airplane p ON p.ID = w.Airplane_ID LEFT JOIN flight_route r USING (Origin_airport, Arrival_airport) LEFT JOIN staff s USING (rid)),
verdict AS (SELECT *, list_filter([
    CASE WHEN minutes IS NULL THEN 'no such route' END, CASE WHEN Airplane_ID IS NULL OR pr IS NULL THEN 'missing field' END, CASE WHEN Size IS NULL THEN 'aircraft not found' END,
    CASE WHEN Size = 'Big' AND pf IS NULL THEN 'Big needs a First price' END, CASE WHEN minutes > 360 AND Size <> 'Big' THEN 'Long needs a Big aircraft' END,
    CASE WHEN staff IS DISTINCT FROM CASE Size WHEN 'Big' THEN '3+6' ELSE '2+3' END THEN 'wrong crew count' END,
    CASE WHEN minutes > 360 AND NOT trained THEN 'crew not trained' END, CASE WHEN NOT seated THEN 'no seats' END, 'ok'], lambda x: x IS NOT NULL)[1] AS reason FROM seen),
made AS (SELECT *, printf('F%05d', (SELECT max(n) FROM f) + row_number() OVER (ORDER BY dep_ts, rid)) AS ID FROM verdict WHERE reason = 'ok')"""


@query("flight_create", f"WITH {CREATED} SELECT v.rid, v.reason, m.ID FROM verdict v LEFT JOIN made m USING (rid)")
def _d17(t):
    return create_flights(t, _requests(t), _crew(t))[0]


@query("flight_create_flight", f"""
WITH {CREATED} SELECT ID, dep_ts, dep_ts + INTERVAL '1' MINUTE * minutes AS arr_ts, 'Active' AS Status, CASE WHEN minutes > 360 THEN 'Long' ELSE 'Short' END AS Type,
  Airplane_ID, Origin_airport, Arrival_airport FROM made
""")
def _d17f(t):
    return create_flights(t, _requests(t), _crew(t))[1]


@query("flight_create_assignment", f"WITH {CREATED} SELECT Aircrew_ID, ID AS Flight_ID FROM crew JOIN made USING (rid)")
def _d17a(t):
    return create_flights(t, _requests(t), _crew(t))[2]


@query("flight_create_ticket", f"""
WITH {CREATED} SELECT m.Airplane_ID, m.ID AS Flight_ID, s.Row_num AS SEAT_Row_num, s.Column_number AS SEAT_Column_number, s.Class_Type AS CLASS_Type,
  CASE s.Class_Type WHEN 'First' THEN coalesce(pf, pr) ELSE pr END AS Price, 1 AS Availability FROM made m JOIN seat s ON s.Airplane_ID = m.Airplane_ID
""")
def _d17t(t):
    return create_flights(t, _requests(t), _crew(t))[3]
