"""Registered queries for the scalar functions F-01 … F-24, each projected over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from skyops.functions import exprs as X
from skyops.plans.catalog import AS_OF, asof, query
from skyops.plans.q_reports import hu

TS = f"TIMESTAMP '{AS_OF}'"


@query("to_ts", """
SELECT ID, COALESCE(try_strptime(d || ' ' || tm, '%Y-%m-%d %H:%M:%S'), try_strptime(d || ' ' || tm, '%Y-%m-%d %H:%M')) AS ts
FROM (SELECT ID, strftime(dep_ts, '%Y-%m-%d') AS d,
             CASE WHEN minute(dep_ts) % 10 = 0 THEN strftime(dep_ts, '%H:%M') ELSE strftime(dep_ts, '%H:%M:%S') END AS tm
      FROM flight) x
""")
def _f01(t):
    tm = F.when(F.minute("dep_ts") % 10 == 0, F.date_format("dep_ts", "HH:mm")).otherwise(F.date_format("dep_ts", "HH:mm:ss"))
    return t.flight.select("ID", X.to_ts(F.date_format("dep_ts", "yyyy-MM-dd"), tm).alias("ts"))


@query("month_slash", "SELECT ID, strftime(Date_of_purchase, '%Y/%m') AS m1, strftime(Date_of_purchase, '%Y-%m') AS m2 FROM booking")
def _f02(t):
    return t.booking.select("ID", X.month_slash("Date_of_purchase").alias("m1"), X.month_dash("Date_of_purchase").alias("m2"))


@query("to_date", "SELECT ID, CAST(dep_ts AS DATE) AS d FROM flight")
def _f03(t):
    return t.flight.select("ID", X.day("dep_ts").alias("d"))


@query("add_minutes", """
SELECT f.ID, f.dep_ts + INTERVAL '1' MINUTE * r.Flight_duration AS arr
FROM flight f JOIN flight_route r ON r.Origin_airport = f.Origin_airport AND r.Arrival_airport = f.Arrival_airport
""")
def _f04(t):
    j = t.flight.join(F.broadcast(t.flight_route), ["Origin_airport", "Arrival_airport"])
    return j.select("ID", X.add_minutes("dep_ts", "Flight_duration").alias("arr"))


@query("hours_until", f"SELECT ID, date_diff('microsecond', {TS}, dep_ts) / 3600000000.0 AS hrs FROM flight")
def _f05(t):
    return t.flight.select("ID", X.hours_until("dep_ts", asof()).alias("hrs"))


@query("flight_type", """
SELECT Origin_airport, Arrival_airport, CASE WHEN Flight_duration > 360 THEN 'Long' ELSE 'Short' END AS Type FROM flight_route
""")
def _f06(t):
    return t.flight_route.select("Origin_airport", "Arrival_airport", X.flight_type("Flight_duration").alias("Type"))


@query("hm", "SELECT ID, substr(strftime(dep_ts, '%H:%M:%S'), 1, 5) AS hm FROM flight")
def _f07(t):
    return t.flight.select("ID", X.hm(F.date_format("dep_ts", "HH:mm:ss")).alias("hm"))


@query("duration_hm", """
SELECT Origin_airport, Arrival_airport, printf('%dh %dm', Flight_duration // 60, Flight_duration % 60) AS d FROM flight_route
""")
def _f08(t):
    return t.flight_route.select("Origin_airport", "Arrival_airport", X.duration_hm("Flight_duration").alias("d"))


@query("currency", f"SELECT ID, '$' || format('{{:,.2f}}', {hu('Total_price')}) AS c FROM booking")
def _f09(t):
    return t.booking.select("ID", X.currency(X.half_up("Total_price", 2)).alias("c"))


@query("concat_name", """
SELECT c.ID, c.First_name || ' ' || c.Last_name || ' (#' || CAST(c.ID AS VARCHAR) || ')' AS crew,
       a.Manufacturer || ' (' || a.Size || ')' AS plane
FROM aircrew c JOIN airplane a ON a.ID = c.ID
""")
def _f10(t):
    a = t.airplane.select("ID", X.plane_label("Manufacturer", "Size").alias("plane"))
    return t.aircrew.select("ID", X.crew_label("First_name", "Last_name", "ID").alias("crew")).join(a, "ID")


@query("route_label", "SELECT Origin_airport || '-' || Arrival_airport AS r FROM flight_route")
def _f10b(t):
    return t.flight_route.select(X.route_label("Origin_airport", "Arrival_airport").alias("r"))


# white space of several kinds that forms send around a value, by a number
PADS = ["", "\t", " \n", "\u00a0", "\r\n", "\u2003 "]
SPACES = "' ' || chr(9) || chr(10) || chr(13) || chr(160) || chr(8195)"


def padded(value: str, n: str) -> F.Column:
    pad = F.expr("element_at(array(" + ", ".join("'" + p.encode("unicode_escape").decode().replace("\\xa0", "\\u00a0") + "'" for p in PADS) + f"), cast(({n}) % {len(PADS)} AS int) + 1)")
    return F.concat(pad, F.col(value), pad)


def padded_sql(value: str, n: str) -> str:
    pad = f"list_extract(['', chr(9), ' ' || chr(10), chr(160), chr(13) || chr(10), chr(8195) || ' '], CAST(({n}) % {len(PADS)} AS INTEGER) + 1)"
    return f"trim({pad} || {value} || {pad}, {SPACES})"


@query("english_name_ok", rf"""
SELECT Email, regexp_full_match({padded_sql("First_name_in_English", "length(Email)")}, '^[A-Za-z](?:[A-Za-z \-'']{{0,48}}[A-Za-z])?$') AS first_ok,
       regexp_full_match({padded_sql("regexp_replace(Last_name_in_English, '[#0-9]', '', 'g')", "length(Email) + 2")}, '^[A-Za-z](?:[A-Za-z \-'']{{0,48}}[A-Za-z])?$') AS last_ok
FROM member
""")
def _f11(t):
    m = t.member.withColumn("last", F.regexp_replace("Last_name_in_English", "[#0-9]", ""))
    return m.select("Email", X.is_english_name(padded("First_name_in_English", "length(Email)")).alias("first_ok"),
                    X.is_english_name(padded("last", "length(Email) + 2")).alias("last_ok"))


@query("positive_int", f"""
SELECT o_orderkey, CASE WHEN regexp_full_match(trim(o_orderpriority), '[0-9]+') AND TRY_CAST(trim(o_orderpriority) AS BIGINT) > 0
                        THEN TRY_CAST(trim(o_orderpriority) AS BIGINT) END AS p1,
       nullif(TRY_CAST({padded_sql("CAST(o_orderkey AS VARCHAR)", "o_orderkey")} AS BIGINT), 0) AS p2
FROM orders
""")
def _f12(t):
    o = t.raw("orders").withColumn("key", F.col("o_orderkey").cast("string"))
    return o.select("o_orderkey", X.positive_int("o_orderpriority").alias("p1"),
                    X.positive_int(padded("key", "o_orderkey")).alias("p2"))


@query("adult_cutoff", f"""
SELECT Email, Date_of_birth <= CAST({TS} AS DATE) - INTERVAL 18 YEAR AS adult FROM member
""")
def _f13(t):
    return t.member.select("Email", X.is_adult("Date_of_birth", asof()).alias("adult"))


@query("flight_code", """
SELECT ID, printf('F%05d', COALESCE(TRY_CAST(substr(ID, 2) AS BIGINT), 0)) AS code,
       COALESCE(TRY_CAST(substr(ID, 2) AS BIGINT), 0) AS n FROM flight
""")
def _f14(t):
    n = X.flight_no("ID")
    return t.flight.select("ID", X.flight_code(n).alias("code"), n.alias("n"))


@query("col_letter", "SELECT Airplane_ID, Class_Type, Row_num, Column_number, chr(ascii(Column_number)) AS letter FROM seat")
def _f15(t):
    return t.seat.select("Airplane_ID", "Class_Type", "Row_num", "Column_number",
                         X.col_letter(F.ascii("Column_number") - 64).alias("letter"))


@query("seat_key_parse", """
SELECT Order_ID, k, split_part(k, '|', 1) AS cls, TRY_CAST(split_part(k, '|', 2) AS INTEGER) AS rw, split_part(k, '|', 3) AS cl
FROM (SELECT Order_ID, CLASS_Type || '|' || CAST(SEAT_Row_num AS VARCHAR) || '|' || SEAT_Column_number AS k FROM ticket_order) x
""")
def _f16(t):
    k = F.concat_ws("|", "CLASS_Type", F.col("SEAT_Row_num").cast("string"), "SEAT_Column_number")
    p = t.ticket_order.select("Order_ID", k.alias("k")).withColumn("s", X.parse_seat_key("k"))
    return p.where(F.col("s").isNotNull()).select("Order_ID", "k", F.col("s.cls").alias("cls"),
                                                  F.col("s.row").alias("rw"), F.col("s.col").alias("cl"))


@query("seat_label", """
SELECT o.Order_ID, o.SEAT_Column_number || CAST(o.SEAT_Row_num AS VARCHAR) AS seat, lower(replace(b.Status, ' ', '-')) AS slug
FROM ticket_order o JOIN booking b ON b.ID = o.Order_ID
""")
def _f17(t):
    j = t.ticket_order.join(t.booking.select(F.col("ID").alias("Order_ID"), "Status"), "Order_ID")
    return j.select("Order_ID", X.seat_label("SEAT_Column_number", "SEAT_Row_num").alias("seat"),
                    X.status_slug("Status").alias("slug"))


@query("cancel_fee", "SELECT ID, floor(Total_price * 5.0 + 0.5) / 100.0 AS fee FROM booking")
def _f18(t):
    return t.booking.select("ID", X.cancel_fee("Total_price").alias("fee"))


@query("local_now", """
SELECT ID, CAST(timezone('Asia/Jerusalem', timezone('UTC', dep_ts)) AS TIMESTAMP) AS local_dep FROM flight
""")
def _f19(t):
    return t.flight.select("ID", X.local_ts("dep_ts").alias("local_dep"))


@query("norm_code", "SELECT upper(trim(' ' || lower(Origin_airport) || ' ')) AS code FROM flight_route")
def _f21(t):
    return t.flight_route.select(X.norm_code(F.concat(F.lit(" "), F.lower("Origin_airport"), F.lit(" "))).alias("code"))


@query("null_default", """
SELECT ID, COALESCE(GUEST_Email, 'none') AS g, COALESCE(TRY_CAST(regexp_extract(trim(CAST(ID AS VARCHAR) || 'x'), '^[+-]?\\d+', 0) AS BIGINT), 0) AS n
FROM booking
""")
def _f22(t):
    return t.booking.select("ID", X.or_default("GUEST_Email", "none").alias("g"),
                            X.lenient_int(F.concat(F.col("ID").cast("string"), F.lit("x"))).alias("n"))


@query("buyer_kind", "SELECT ID, CASE WHEN MEMBER_Email IS NOT NULL THEN 'Member' ELSE 'Guest' END AS kind FROM booking")
def _f23(t):
    return t.booking.select("ID", X.buyer_kind("MEMBER_Email", "GUEST_Email").alias("kind"))


@query("clamp_qty", """
SELECT l_orderkey, l_linenumber, l_partkey,
       least(greatest(1, COALESCE(TRY_CAST(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) AS INTEGER), 1)), l_linenumber) AS q
FROM lineitem
""")
def _f24(t):
    li = t.raw("lineitem")
    return li.select("l_orderkey", "l_linenumber", "l_partkey",
                     X.clamp_qty(F.col("l_quantity").cast("int").cast("string"), "l_linenumber").alias("q"))
