"""Registered data-quality checks V-01 … V-07."""

from __future__ import annotations

import functools
from dataclasses import replace

from pyspark.sql import functions as F

from skyops.operators import quality as Q
from skyops.plans.catalog import AS_OF, asof, query

TS = f"TIMESTAMP '{AS_OF}'"


def k(*cols):
    return "concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in cols) + ")"


PK = {tb: k(*cols) for tb, cols in Q.PRIMARY_KEYS.items()}

# Violations added to the derived tables, at least one kind per rule: copies of the rows that meet a condition, with a column replaced by an expression
# (None: a plain copy). Conditions and expressions are SQL that both engines read alike.
COPIES = {
    "aircrew": "ID % 50 = 7", "flight_route": "Flight_duration % 50 = 7", "guest": "length(Email) % 4 = 3", "member": "length(Email) % 4 = 3", "booking": "ID % 97 = 5",
    "phone_number_guest": "length(Email) % 4 = 3", "phone_number_member": "length(Email) % 4 = 3", "airplane": "ID % 7 = 1", "class": "Airplane_ID % 7 = 1",
    "seat": "Airplane_ID % 7 = 1 AND Row_num = 1", "flight": "ID LIKE '%77'", "ticket": "Flight_ID LIKE '%77' AND SEAT_Row_num = 1",
    "ticket_order": "Order_ID % 97 = 5", "aircrew_assignment": "Aircrew_ID % 50 = 7",
}
BROKEN = [
    ("aircrew", "Type", "'Robot'"), ("flight_route", "Flight_duration", "-Flight_duration"), ("booking", "Status", "'Lost'"), ("airplane", "Manufacturer", "'Fokker'"),
    ("airplane", "Size", "'Huge'"), ("class", "Type", "'Coach'"), ("class", "Number_of_rows", "0"), ("class", "Number_of_columns", "-1"), ("seat", "Class_Type", "'Coach'"),
    ("seat", "Column_number", "'a'"), ("seat", "Row_num", "0"), ("flight", "Status", "'Late'"), ("flight", "Type", "'Medium'"), ("ticket", "CLASS_Type", "'Coach'"),
    ("ticket_order", "CLASS_Type", "'Coach'"),
    # keys without a parent
    ("booking", "GUEST_Email", "'no' || GUEST_Email"), ("booking", "MEMBER_Email", "'no' || MEMBER_Email"), ("phone_number_guest", "Email", "'no' || Email"),
    ("phone_number_member", "Email", "'no' || Email"), ("class", "Airplane_ID", "-Airplane_ID"), ("seat", "Airplane_ID", "Airplane_ID + 1000000"), ("flight", "Airplane_ID", "-Airplane_ID"),
    ("flight", "Origin_airport", "'NOWHERE'"), ("ticket", "SEAT_Row_num", "99"), ("ticket", "Flight_ID", "'X' || Flight_ID"), ("ticket_order", "SEAT_Row_num", "99"),
    ("ticket_order", "Order_ID", "-Order_ID"), ("aircrew_assignment", "Aircrew_ID", "-Aircrew_ID"), ("aircrew_assignment", "Flight_ID", "'X' || Flight_ID"),
]


def broken_rows() -> list[tuple[str, str | None, str | None]]:
    """(table, column, expression): plain copies, :data:`BROKEN`, and a missing value for each required column (blank text in every second one)."""
    missing = [(tb, c, "'  '" if c in TEXT or (tb == "flight" and c == "ID") else "NULL") for tb, cols in REQUIRED.items() for c in cols]
    return [(tb, None, None) for tb in COPIES] + BROKEN + missing + [(tb, c, "NULL") for tb, c, e in missing[::2] if e != "NULL"]


def with_broken_rows(t):
    """The airline tables with :func:`broken_rows`. Each row is followed by its copies where it is read, so a table is derived once, however many
    rules it breaks."""
    kinds = {}
    for tb, c, e in broken_rows():
        kinds.setdefault(tb, []).append((c, e))
    seeded = {}
    for tb, df in t.tables().items():
        if tb in kinds:
            def row(c=None, e=None, df=df):
                return F.struct(*[(F.expr(e).cast(f.dataType) if f.name == c else F.col(f.name)).alias(f.name) for f in df.schema.fields])
            copies = F.when(F.expr(COPIES[tb]), F.array(row(), *[row(c, e) for c, e in kinds[tb]])).otherwise(F.array(row()))
            seeded[tb] = df.select(F.explode(copies).alias("r")).select("r.*")
    seeded["klass"] = seeded.pop("class")
    return replace(t, **seeded)


def broken_sql(query: str) -> str:
    """``query`` over the tables with :func:`broken_rows`, which it calls ``s_<table>``."""
    parts = {tb: [f"SELECT * FROM {tb}"] for tb in COPIES}
    for tb, c, e in broken_rows():
        parts[tb].append(f"SELECT * {'' if c is None else f'REPLACE ({e} AS {c}) '}FROM {tb} WHERE {COPIES[tb]}")
    return "WITH " + ",\n".join(f"s_{tb} AS ({' UNION ALL '.join(p)})" for tb, p in parts.items()) + "\n" + query


DOMAIN_SQL = [
    ("aircrew", "type_domain", "Type IN ('Pilot', 'Flight attendant')"),
    ("flight_route", "duration_positive", "Flight_duration > 0"),
    ("booking", "status_domain", "Status IN ('Active', 'Completed', 'Customer Cancellation', 'System Cancellation')"),
    ("airplane", "manufacturer_domain", "Manufacturer IN ('Boeing', 'Airbus', 'Dassault')"),
    ("airplane", "size_domain", "Size IN ('Big', 'Small')"),
    ("class", "type_domain", "Type IN ('First', 'Regular')"),
    ("class", "rows_cols_positive", "Number_of_rows > 0 AND Number_of_columns > 0"),
    ("seat", "class_domain", "Class_Type IN ('First', 'Regular')"),
    ("seat", "column_letter", "Column_number BETWEEN 'A' AND 'Z'"),
    ("seat", "row_positive", "Row_num > 0"),
    ("flight", "status_domain", "Status IN ('Active', 'Full', 'Completed', 'Canceled')"),
    ("flight", "type_domain", "Type IN ('Long', 'Short')"),
    ("ticket", "class_domain", "CLASS_Type IN ('First', 'Regular')"),
    ("ticket_order", "class_domain", "CLASS_Type IN ('First', 'Regular')"),
]


REQUIRED = {
    "aircrew": ["ID", "City", "Street", "House_Number", "Start_date_of_employment", "First_name", "Last_name",
                "Phone_number", "Type", "Training"],
    "flight_route": ["Origin_airport", "Arrival_airport", "Flight_duration"],
    "guest": ["Email", "First_name_in_English", "Last_name_in_English"],
    "member": ["Email", "First_name_in_English", "Last_name_in_English", "Passport_number", "Date_of_birth",
               "Register_date"],
    "booking": ["ID", "Status", "Total_price", "Date_of_purchase", "Cancellation_fee"],
    "phone_number_guest": ["Email", "Phone_number"], "phone_number_member": ["Email", "Phone_number"],
    "airplane": ["ID", "Date_of_purchase", "Manufacturer", "Size"],
    "class": ["Type", "Airplane_ID", "Number_of_rows", "Number_of_columns"],
    "seat": ["Class_Type", "Airplane_ID", "Row_num", "Column_number"],
    "flight": ["ID", "dep_ts", "arr_ts", "Status", "Type", "Airplane_ID", "Origin_airport", "Arrival_airport"],
    "ticket": ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type", "Price", "Availability"],
    "ticket_order": ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type", "Order_ID"],
    "aircrew_assignment": ["Aircrew_ID", "Flight_ID"],
}
TEXT = {"City", "Street", "House_Number", "First_name", "Last_name", "Phone_number", "Type", "Origin_airport",
        "Arrival_airport", "Email", "First_name_in_English", "Last_name_in_English", "Passport_number", "Status",
        "Manufacturer", "Size", "Class_Type", "Column_number", "ID_TEXT", "Flight_ID", "SEAT_Column_number", "CLASS_Type"}


def _nn(tb, c):
    is_text = c in TEXT or (tb == "flight" and c == "ID")
    cond = f"{c} IS NULL" + (f" OR trim({c}) = ''" if is_text else "")
    return f"SELECT '{tb}' AS tbl, {PK[tb]} AS key, '{c}' AS col FROM s_{tb} WHERE {cond}"


@query("check_domain", broken_sql("\nUNION ALL\n".join(
    f"SELECT '{tb}' AS tbl, {PK[tb]} AS key, '{rule}' AS rule FROM s_{tb} WHERE NOT COALESCE({ok}, false)"
    for tb, rule, ok in DOMAIN_SQL)))
def _v01(t):
    return Q.check_domain(with_broken_rows(t))


@query("check_unique", broken_sql("\nUNION ALL\n".join(
    f"SELECT '{tb}' AS tbl, {k(*cols)} AS key, COUNT(*) AS n FROM s_{tb} GROUP BY {', '.join(cols)} HAVING COUNT(*) > 1"
    for tb, cols in Q.PRIMARY_KEYS.items())))
def _v02(t):
    return Q.check_unique(with_broken_rows(t))


@query("check_fk", broken_sql("\nUNION ALL\n".join(
    f"SELECT '{ch}' AS tbl, {PK[ch]} AS key, '{pa}' AS parent FROM s_{ch} c WHERE "
    + " AND ".join(f"c.{x} IS NOT NULL" for x in cc)
    + f" AND NOT EXISTS (SELECT 1 FROM s_{pa} p WHERE "
    + " AND ".join(f"p.{b} = c.{a}" for a, b in zip(cc, pc)) + ")"
    for ch, cc, pa, pc in Q.FOREIGN_KEYS)))
def _v03(t):
    return Q.check_fk(with_broken_rows(t))


@query("check_not_null", broken_sql("\nUNION ALL\n".join(_nn(tb, c) for tb, cols in REQUIRED.items() for c in cols)))
def _v04(t):
    return Q.check_not_null(with_broken_rows(t))


def people_rows(t):
    c = t.raw("customer")
    dob = F.date_format(F.date_add(F.to_date(F.lit("1975-01-01")), (F.col("c_custkey") % 10000).cast("int")), "yyyy-MM-dd")
    return c.select(F.concat(F.lit("m"), F.col("c_custkey").cast("string"), F.lit("@example.com")).alias("email"),
                    F.col("c_mktsegment").alias("first"),
                    F.regexp_replace("c_name", "[#0-9]", "").alias("last"),
                    F.concat(F.lit("P"), F.col("c_custkey").cast("string")).alias("passport"),
                    F.when(F.col("c_custkey") % 97 == 0, F.lit("not-a-date")).otherwise(dob).alias("dob"),
                    F.concat(F.lit("05"), F.col("c_custkey").cast("string")).alias("phone"))


@query("validate_people", f"""
WITH rows AS (
  SELECT 'm' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email, c_mktsegment AS first,
         regexp_replace(c_name, '[#0-9]', '', 'g') AS last, 'P' || CAST(c_custkey AS VARCHAR) AS passport,
         CASE WHEN c_custkey % 97 = 0 THEN 'not-a-date'
              ELSE strftime(DATE '1975-01-01' + CAST(c_custkey % 10000 AS INTEGER), '%Y-%m-%d') END AS dob,
         '05' || CAST(c_custkey AS VARCHAR) AS phone
  FROM customer),
p AS (SELECT r.*, TRY_CAST(try_strptime(trim(dob), '%Y-%m-%d') AS DATE) AS d,
             trim(email) IN (SELECT Email FROM member) AS is_member FROM rows r)
SELECT email, first, last, passport, dob, phone,
  CASE WHEN trim(COALESCE(email, '')) = '' OR trim(COALESCE(first, '')) = '' OR trim(COALESCE(last, '')) = ''
            OR trim(COALESCE(passport, '')) = '' OR trim(COALESCE(dob, '')) = '' OR trim(COALESCE(phone, '')) = ''
         THEN 'missing field'
       WHEN NOT regexp_full_match(trim(first), '^[A-Za-z](?:[A-Za-z \\-'']{{0,48}}[A-Za-z])?$') THEN 'first name not English'
       WHEN NOT regexp_full_match(trim(last), '^[A-Za-z](?:[A-Za-z \\-'']{{0,48}}[A-Za-z])?$') THEN 'last name not English'
       WHEN d IS NULL THEN 'bad date of birth'
       WHEN NOT (d <= CAST({TS} AS DATE) - INTERVAL 18 YEAR) THEN 'under 18'
       WHEN is_member THEN 'email exists'
       ELSE 'ok' END AS reason
FROM p
""")
def _v05(t):
    return Q.validate_people(people_rows(t), t, asof())


def aircraft_rows(t):
    """Configurations derived from the suppliers; by remainder each fails another check."""
    s = t.raw("supplier")
    k = F.col("s_suppkey") % 14
    new_id = (F.col("s_suppkey") + 10_000_000).cast("string")
    pick = lambda cases, other: functools.reduce(lambda c, x: c.when(k == x[0], F.lit(x[1])), cases[1:], F.when(k == cases[0][0], F.lit(cases[0][1]))).otherwise(other)
    return s.select(
        F.when(k == 6, F.concat(F.lit("-"), new_id)).when(k.isin(8, 9), F.col("s_suppkey").cast("string")).when(k == 13, F.lit("1x")).otherwise(new_id).alias("airplane_id"),
        pick([(1, "1990-13-40"), (2, "2030-01-01"), (12, " ")], F.lit("1990-01-01")).alias("purchase_date"),
        pick([(0, None)], F.lit("Boeing")).alias("manufacturer"),
        pick([(3, "Small"), (10, "Small"), (11, "Small")], F.lit("Big")).alias("size"),
        pick([(4, "seven"), (11, "0")], F.lit(" 7 ")).alias("reg_rows"),
        pick([(5, "27")], F.lit("6")).alias("reg_cols"),
        pick([(7, ""), (9, "0")], F.lit("2")).alias("first_rows"),
        pick([(3, "2.5"), (7, "4"), (10, None)], F.lit("4")).alias("first_cols"))


def _whole(c):
    return f"CASE WHEN regexp_full_match(trim({c}), '[+-]?[0-9]+') THEN TRY_CAST(trim({c}) AS BIGINT) END"


# remainder of the supplier key -> what the row of aircraft_rows is refused for
@query("validate_aircraft", f"""
WITH k AS (SELECT s_suppkey AS key, s_suppkey % 14 AS k, CAST(s_suppkey + 10000000 AS VARCHAR) AS fresh FROM supplier),
rows AS (
  SELECT CASE k WHEN 6 THEN '-' || fresh WHEN 8 THEN CAST(key AS VARCHAR) WHEN 9 THEN CAST(key AS VARCHAR) WHEN 13 THEN '1x' ELSE fresh END AS airplane_id,
         CASE k WHEN 1 THEN '1990-13-40' WHEN 2 THEN '2030-01-01' WHEN 12 THEN ' ' ELSE '1990-01-01' END AS purchase_date,
         CASE k WHEN 0 THEN NULL ELSE 'Boeing' END AS manufacturer, CASE WHEN k IN (3, 10, 11) THEN 'Small' ELSE 'Big' END AS size,
         CASE k WHEN 4 THEN 'seven' WHEN 11 THEN '0' ELSE ' 7 ' END AS reg_rows, CASE k WHEN 5 THEN '27' ELSE '6' END AS reg_cols,
         CASE k WHEN 7 THEN '' WHEN 9 THEN '0' ELSE '2' END AS first_rows, CASE k WHEN 3 THEN '2.5' WHEN 10 THEN NULL ELSE '4' END AS first_cols
  FROM k),
n AS (SELECT *, {_whole('airplane_id')} AS id, {_whole('reg_rows')} AS rr, {_whole('reg_cols')} AS rc, {_whole('first_rows')} AS fr, {_whole('first_cols')} AS fc,
             TRY_CAST(try_strptime(trim(purchase_date), '%Y-%m-%d') AS DATE) AS day FROM rows),
-- every rule with its rank; the lowest rank that applies is the answer
broken AS (
  SELECT airplane_id, purchase_date, manufacturer, size, reg_rows, reg_cols, first_rows, first_cols,
    list_filter([
      CASE WHEN list_bool_or([coalesce(trim(x), '') = '' FOR x IN [airplane_id, purchase_date, manufacturer, size, reg_rows, reg_cols]]) THEN 'missing field' END,
      CASE WHEN day IS NULL THEN 'bad date' END,
      CASE WHEN day > CAST({TS} AS DATE) THEN 'date in the future' END,
      CASE WHEN id IS NULL OR rr IS NULL OR rc IS NULL OR (trim(first_rows) <> '' AND fr IS NULL) OR (trim(first_cols) <> '' AND fc IS NULL) THEN 'not numeric' END,
      CASE WHEN greatest(rc, coalesce(fc, 0)) > 26 THEN 'too many columns' END,
      CASE WHEN least(id, rr, rc) <= 0 THEN 'not positive' END,
      CASE WHEN size <> 'Small' AND least(coalesce(fr, 0), coalesce(fc, 0)) <= 0 THEN 'Big needs First' END,
      CASE WHEN id IN (SELECT ID FROM airplane) THEN 'id exists' END, 'ok'], lambda r: r IS NOT NULL)[1] AS reason
  FROM n)
SELECT * FROM broken
""")
def _v06(t):
    return Q.validate_aircraft(aircraft_rows(t), t, asof())


def aircrew_rows(t):
    """Crew rows derived from the customers; by remainder each fails another check."""
    c, k = t.raw("customer"), F.col("c_custkey") % 12
    fresh = (F.col("c_custkey") + 10_000_000).cast("string")
    return c.select(
        F.when(k == 1, F.lit("12a")).when(k == 2, F.concat(F.lit("-"), fresh)).when(k == 7, F.col("c_custkey").cast("string")).otherwise(fresh).alias("id"),
        F.when(k == 3, F.lit("Zoë 4")).otherwise(F.lit(" Ann-Marie ")).alias("first"), F.when(k == 4, F.lit("O")).when(k == 8, F.lit("9")).otherwise(F.lit("O'Neil")).alias("last"),
        F.lit("050").alias("phone"), F.lit("City").alias("city"), F.lit("Street").alias("street"),
        F.when(k == 5, F.lit("5b")).when(k == 6, F.lit("0")).otherwise(F.lit("7")).alias("house"),
        F.lit("2001-01-01").alias("start"), F.when(k == 0, F.lit(" ")).when(k == 9, F.lit(None)).otherwise(F.lit("Pilot")).alias("type"))


# the answer by remainder of the customer key, written out
@query("validate_aircrew", """
WITH k AS (SELECT c_custkey AS key, c_custkey % 12 AS k, CAST(c_custkey + 10000000 AS VARCHAR) AS fresh FROM customer),
answer(k, reason) AS (VALUES (0, 'missing field'), (1, 'id not numeric'), (2, 'id not positive'), (3, 'first name not English'), (4, 'ok'), (5, 'house number not numeric'),
  (6, 'house number not positive'), (7, 'id exists'), (8, 'last name not English'), (9, 'missing field'), (10, 'ok'), (11, 'ok'))
SELECT CASE k WHEN 1 THEN '12a' WHEN 2 THEN '-' || fresh WHEN 7 THEN CAST(key AS VARCHAR) ELSE fresh END AS id,
       CASE k WHEN 3 THEN 'Zoë 4' ELSE ' Ann-Marie ' END AS first, CASE k WHEN 4 THEN 'O' WHEN 8 THEN '9' ELSE 'O''Neil' END AS last,
       '050' AS phone, 'City' AS city, 'Street' AS street, CASE k WHEN 5 THEN '5b' WHEN 6 THEN '0' ELSE '7' END AS house, '2001-01-01' AS start,
       CASE k WHEN 0 THEN ' ' WHEN 9 THEN NULL ELSE 'Pilot' END AS type, reason
FROM k JOIN answer USING (k)
""")
def _v08(t):
    return Q.validate_aircrew(aircrew_rows(t), t)


@query("check_seat_state", """
WITH act AS (SELECT x.Airplane_ID, x.Flight_ID, x.SEAT_Row_num, x.SEAT_Column_number, x.CLASS_Type, COUNT(*) AS n_active
             FROM ticket_order x JOIN booking b ON b.ID = x.Order_ID WHERE b.Status = 'Active' GROUP BY 1, 2, 3, 4, 5)
SELECT Airplane_ID, Flight_ID, SEAT_Row_num, SEAT_Column_number, CLASS_Type, 'double sold' AS issue FROM act WHERE n_active > 1
UNION ALL
SELECT t.Airplane_ID, t.Flight_ID, t.SEAT_Row_num, t.SEAT_Column_number, t.CLASS_Type, 'availability mismatch'
FROM ticket t JOIN flight f ON f.ID = t.Flight_ID
LEFT JOIN act a ON a.Airplane_ID = t.Airplane_ID AND a.Flight_ID = t.Flight_ID AND a.SEAT_Row_num = t.SEAT_Row_num
  AND a.SEAT_Column_number = t.SEAT_Column_number AND a.CLASS_Type = t.CLASS_Type
WHERE t.Availability <> CASE WHEN f.Status = 'Canceled' OR COALESCE(a.n_active, 0) > 0 THEN 0 ELSE 1 END
""")
def _v07(t):
    return Q.check_seat_state(t)
