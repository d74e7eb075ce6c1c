"""DuckDB text of the airline views (FIXTURES.md §C), used as the ``WITH`` prefix of every
oracle query. This is the independent SQL statement of the same rules that
:mod:`skyops.sources.airline` implements with the DataFrame API.
"""

from __future__ import annotations

# name -> SELECT text, in dependency order
VIEWS: list[tuple[str, str]] = [
    ("airplane", """
SELECT s_suppkey AS ID, CAST('1990-01-01' AS DATE) AS Date_of_purchase,
       CASE s_nationkey % 3 WHEN 0 THEN 'Boeing' WHEN 1 THEN 'Airbus' ELSE 'Dassault' END AS Manufacturer,
       CASE WHEN s_suppkey % 2 = 0 THEN 'Big' ELSE 'Small' END AS Size
FROM supplier"""),
    ("class", """
SELECT 'Regular' AS Type, ID AS Airplane_ID, 7 AS Number_of_rows, 6 AS Number_of_columns FROM airplane
UNION ALL SELECT 'First', ID, 2, 4 FROM airplane WHERE Size = 'Big'"""),
    ("seat", """
SELECT k.Type AS Class_Type, k.Airplane_ID, r.n AS Row_num, substr('ABCDEF', c.n, 1) AS Column_number
FROM class k
JOIN (VALUES (1),(2),(3),(4),(5),(6),(7)) AS r(n) ON r.n <= k.Number_of_rows
JOIN (VALUES (1),(2),(3),(4),(5),(6)) AS c(n) ON c.n <= k.Number_of_columns"""),
    ("flight_route", """
SELECT a.n_name AS Origin_airport, b.n_name AS Arrival_airport,
       60 + (a.n_nationkey * 37 + b.n_nationkey * 53) % 600 AS Flight_duration
FROM nation a CROSS JOIN nation b WHERE a.n_nationkey <> b.n_nationkey"""),
    ("flight_base", """
SELECT p_partkey, p_size, p_retailprice, p_partkey % (SELECT count(*) FROM supplier) AS Airplane_ID,
       p_partkey % 25 AS o, (p_partkey % 25 + 1 + p_size % 24) % 25 AS a,
       TIMESTAMP '1999-01-01 00:00:00'
         + INTERVAL '1' MINUTE * CAST((p_partkey % 1095) * 1440 + (p_partkey % 24) * 60 + (p_partkey % 12) * 5 AS INT) AS dep_ts
FROM part"""),
    ("flight_x", """
SELECT printf('F%07d', CAST(f.p_partkey AS BIGINT)) AS ID, f.dep_ts,
       f.dep_ts + INTERVAL '1' MINUTE * CAST(r.Flight_duration AS INT) AS arr_ts,
       CASE WHEN f.p_size % 10 = 0 THEN 'Canceled'
            WHEN f.dep_ts <= TIMESTAMP '2001-01-01 00:00:00' THEN 'Completed'
            WHEN f.p_size % 10 = 1 THEN 'Full' ELSE 'Active' END AS Status,
       CASE WHEN r.Flight_duration > 360 THEN 'Long' ELSE 'Short' END AS Type,
       f.Airplane_ID, r.Origin_airport, r.Arrival_airport, f.p_retailprice
FROM flight_base f
JOIN nation no1 ON no1.n_nationkey = f.o
JOIN nation na1 ON na1.n_nationkey = f.a
JOIN flight_route r ON r.Origin_airport = no1.n_name AND r.Arrival_airport = na1.n_name"""),
    ("flight", """
SELECT ID, dep_ts, arr_ts, Status, Type, Airplane_ID, Origin_airport, Arrival_airport FROM flight_x"""),
    ("booking", """
SELECT o_orderkey AS ID,
       CASE WHEN o_orderstatus = 'F' THEN 'Completed' WHEN o_orderstatus = 'O' THEN 'Active'
            WHEN o_orderkey % 2 = 0 THEN 'Customer Cancellation' ELSE 'System Cancellation' END AS Status,
       o_totalprice AS Total_price, CAST(o_orderdate AS DATE) AS Date_of_purchase,
       floor(o_totalprice * 5 + CAST(0.5 AS DOUBLE)) / CAST(100 AS DOUBLE) AS Cancellation_fee,
       CASE WHEN o_custkey % 3 = 0 AND o_custkey % 30 <> 0 THEN 'g' || CAST(o_custkey AS VARCHAR(10)) || '@example.com' END AS GUEST_Email,
       CASE WHEN o_custkey % 3 <> 0 THEN 'm' || CAST(o_custkey AS VARCHAR(10)) || '@example.com' END AS MEMBER_Email
FROM orders"""),
    ("ticket_order", """
SELECT DISTINCT f.Airplane_ID, f.ID AS Flight_ID, l.l_linenumber AS SEAT_Row_num,
       substr('ABCDEF', CAST(l.l_suppkey % 6 + 1 AS INT), 1) AS SEAT_Column_number,
       CASE WHEN f.Airplane_ID % 2 = 0 AND l.l_linenumber <= 2 AND l.l_suppkey % 6 < 4 THEN 'First' ELSE 'Regular' END AS CLASS_Type,
       l.l_orderkey AS Order_ID
FROM lineitem l JOIN flight_x f ON f.ID = printf('F%07d', CAST(l.l_partkey AS BIGINT))"""),
    ("ticket", """
SELECT f.Airplane_ID, f.ID AS Flight_ID, s.Row_num AS SEAT_Row_num, s.Column_number AS SEAT_Column_number, s.Class_Type AS CLASS_Type,
       CASE WHEN s.Class_Type = 'First' THEN f.p_retailprice * 3 ELSE f.p_retailprice END AS Price,
       CASE WHEN f.Status = 'Canceled' OR x.Flight_ID IS NOT NULL THEN 0 ELSE 1 END AS Availability
FROM flight_x f JOIN seat s ON s.Airplane_ID = f.Airplane_ID
LEFT JOIN (SELECT DISTINCT t.Flight_ID, t.SEAT_Row_num, t.SEAT_Column_number, t.CLASS_Type
           FROM ticket_order t JOIN booking b ON b.ID = t.Order_ID WHERE b.Status = 'Active') x
  ON x.Flight_ID = f.ID AND x.SEAT_Row_num = s.Row_num AND x.SEAT_Column_number = s.Column_number AND x.CLASS_Type = s.Class_Type"""),
    ("aircrew", """
SELECT c_custkey AS ID, 'City' AS City, 'Street' AS Street, '1' AS House_Number, CAST('1990-01-01' AS DATE) AS Start_date_of_employment,
       c_mktsegment AS First_name, c_name AS Last_name, '050' AS Phone_number,
       CASE WHEN c_custkey % 3 = 0 THEN 'Pilot' ELSE 'Flight attendant' END AS Type, c_nationkey % 2 AS Training
FROM customer"""),
    ("aircrew_assignment", """
SELECT DISTINCT o.o_custkey AS Aircrew_ID, printf('F%07d', CAST(l.l_partkey AS BIGINT)) AS Flight_ID
FROM orders o JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_linenumber = 1"""),
    ("member", """
SELECT 'm' || CAST(c_custkey AS VARCHAR(10)) || '@example.com' AS Email, c_mktsegment AS First_name_in_English,
       c_name AS Last_name_in_English, 'P' || CAST(c_custkey AS VARCHAR(10)) AS Passport_number,
       CAST('1980-01-01' AS DATE) AS Date_of_birth, CAST('1999-01-01' AS DATE) AS Register_date
FROM customer WHERE c_custkey % 3 <> 0"""),
    ("guest", """
SELECT 'g' || CAST(c_custkey AS VARCHAR(10)) || '@example.com' AS Email, c_mktsegment AS First_name_in_English, c_name AS Last_name_in_English
FROM customer WHERE c_custkey % 3 = 0"""),
    ("phone_number_member", """
SELECT m.Email, '05' || CAST(p.n AS VARCHAR(1)) || m.Passport_number AS Phone_number
FROM member m JOIN (VALUES (0),(2)) AS p(n) ON 1 = 1"""),
    ("phone_number_guest", """
SELECT Email, '054' || Email AS Phone_number FROM guest"""),
    ("airport", """
SELECT n.n_name AS Code, concat_ws(' — ', n.n_name, r.r_name) AS Label
FROM nation n LEFT JOIN region r ON r.r_regionkey = n.n_regionkey"""),
]

def with_views(query: str) -> str:
    """Prefix ``query`` with the airline views as CTEs."""
    ctes = ",\n".join(f"{name} AS ({body.strip()})" for name, body in VIEWS)
    q = query.strip()
    if q.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{q[15:]}"
    if q.upper().startswith("WITH "):
        return f"WITH {ctes},\n{q[5:]}"
    return f"WITH {ctes}\n{q}"
