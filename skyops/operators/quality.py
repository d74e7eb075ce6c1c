"""Data-quality checks (V-01 … V-07), re-aimed from the schema's constraints and the form
validation of the reference. Each check returns a violations frame; an empty frame means
the data is clean. Rules are data (lists below) compiled into one union plan.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyops.functions import exprs as X
from skyops.sources.airline import Airline, order_links

# ---- fixed values: domains and keys of the schema -------------------------------------------
CREW_TYPES = ("Pilot", "Flight attendant")
ORDER_STATUSES = ("Active", "Completed", "Customer Cancellation", "System Cancellation")
MANUFACTURERS = ("Boeing", "Airbus", "Dassault")
SIZES = ("Big", "Small")
CLASSES = ("First", "Regular")
FLIGHT_STATUSES = ("Active", "Full", "Completed", "Canceled")
FLIGHT_TYPES = ("Long", "Short")

PRIMARY_KEYS = {
    "aircrew": ["ID"], "flight_route": ["Origin_airport", "Arrival_airport"], "guest": ["Email"],
    "member": ["Email"], "booking": ["ID"], "phone_number_guest": ["Email", "Phone_number"],
    "phone_number_member": ["Email", "Phone_number"], "airplane": ["ID"], "class": ["Airplane_ID", "Type"],
    "seat": ["Airplane_ID", "Class_Type", "Row_num", "Column_number"], "flight": ["ID"],
    "ticket": ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"],
    "ticket_order": ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type", "Order_ID"],
    "aircrew_assignment": ["Aircrew_ID", "Flight_ID"],
}

# (child table, child columns, parent table, parent columns)
FOREIGN_KEYS = [
    ("booking", ["GUEST_Email"], "guest", ["Email"]),
    ("booking", ["MEMBER_Email"], "member", ["Email"]),
    ("phone_number_guest", ["Email"], "guest", ["Email"]),
    ("phone_number_member", ["Email"], "member", ["Email"]),
    ("class", ["Airplane_ID"], "airplane", ["ID"]),
    ("seat", ["Airplane_ID", "Class_Type"], "class", ["Airplane_ID", "Type"]),
    ("flight", ["Airplane_ID"], "airplane", ["ID"]),
    ("flight", ["Origin_airport", "Arrival_airport"], "flight_route", ["Origin_airport", "Arrival_airport"]),
    ("ticket", ["Airplane_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number"], "seat",
     ["Airplane_ID", "Class_Type", "Row_num", "Column_number"]),
    ("ticket", ["Flight_ID"], "flight", ["ID"]),
    ("ticket_order", ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"], "ticket",
     ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"]),
    ("ticket_order", ["Order_ID"], "booking", ["ID"]),
    ("aircrew_assignment", ["Aircrew_ID"], "aircrew", ["ID"]),
    ("aircrew_assignment", ["Flight_ID"], "flight", ["ID"]),
]

NULLABLE = {("booking", "GUEST_Email"), ("booking", "MEMBER_Email")}


def _key(cols: list[str]) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def _in(col: str, values) -> Column:
    return F.coalesce(F.col(col).isin(*values), F.lit(False))


def _domain_rules() -> list[tuple[str, str, Column]]:
    """(table, rule, predicate that must hold)."""
    return [
        ("aircrew", "type_domain", _in("Type", CREW_TYPES)),
        ("flight_route", "duration_positive", F.coalesce(F.col("Flight_duration") > 0, F.lit(False))),
        ("booking", "status_domain", _in("Status", ORDER_STATUSES)),
        ("airplane", "manufacturer_domain", _in("Manufacturer", MANUFACTURERS)),
        ("airplane", "size_domain", _in("Size", SIZES)),
        ("class", "type_domain", _in("Type", CLASSES)),
        ("class", "rows_cols_positive", F.coalesce((F.col("Number_of_rows") > 0) & (F.col("Number_of_columns") > 0),
                                                   F.lit(False))),
        ("seat", "class_domain", _in("Class_Type", CLASSES)),
        ("seat", "column_letter", F.coalesce(F.col("Column_number").between("A", "Z"), F.lit(False))),
        ("seat", "row_positive", F.coalesce(F.col("Row_num") > 0, F.lit(False))),
        ("flight", "status_domain", _in("Status", FLIGHT_STATUSES)),
        ("flight", "type_domain", _in("Type", FLIGHT_TYPES)),
        ("ticket", "class_domain", _in("CLASS_Type", CLASSES)),
        ("ticket_order", "class_domain", _in("CLASS_Type", CLASSES)),
    ]


def _union(frames: list[DataFrame]) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b), frames)


def check_domain(t: Airline) -> DataFrame:
    """V-01: rows breaking an enumeration / positivity / letter rule → (tbl, key, rule); one pass per table."""
    tabs, rules = t.tables(), {}
    for tb, rule, ok in _domain_rules():
        rules.setdefault(tb, []).append((~ok, rule))
    return _union([_broken(tabs[tb], tb, checks, "rule") for tb, checks in rules.items()])


def _broken(df: DataFrame, tb: str, checks: list[tuple[Column, str]], out: str) -> DataFrame:
    """(tbl, key, ``out``): a row for each check, ``(broken, name)``, that a row of ``df`` fails."""
    names = F.array_compact(F.array(*[F.when(bad, F.lit(name)) for bad, name in checks]))
    return df.select(F.lit(tb).alias("tbl"), _key(PRIMARY_KEYS[tb]).alias("key"), F.explode(names).alias(out))


def check_unique(t: Airline) -> DataFrame:
    """V-02: primary-key values present more than once → (tbl, key, n)."""
    tabs = t.tables()
    return _union([tabs[tb].groupBy(*ks).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
                   .select(F.lit(tb).alias("tbl"), _key(ks).alias("key"), "n")
                   for tb, ks in PRIMARY_KEYS.items()])


def check_fk(t: Airline) -> DataFrame:
    """V-03: child rows whose (non-null) foreign key has no parent → (tbl, key, parent)."""
    tabs = t.tables()
    out = []
    for child, cc, parent, pc in FOREIGN_KEYS:
        c = tabs[child].where(functools.reduce(lambda a, b: a & b, [F.col(x).isNotNull() for x in cc]))
        p = tabs[parent].select(*[F.col(a).alias(b) for a, b in zip(pc, cc)])  # repeated keys do no harm to an anti join
        out.append(c.join(p, cc, "left_anti").select(F.lit(child).alias("tbl"), _key(PRIMARY_KEYS[child]).alias("key"),
                                                     F.lit(parent).alias("parent")))
    return _union(out)


def check_not_null(t: Airline) -> DataFrame:
    """V-04: required fields that are NULL or blank text → (tbl, key, col); one pass per table."""
    out = []
    for tb, df in t.tables().items():
        if tb not in PRIMARY_KEYS:
            continue
        required = [f for f in df.schema.fields if (tb, f.name) not in NULLABLE]
        blank = {f.name: X.strip(f.name) == "" for f in required if f.dataType.simpleString() == "string"}
        out.append(_broken(df, tb, [(F.col(f.name).isNull() | blank.get(f.name, F.lit(False)), f.name) for f in required], "col"))
    return _union(out)


def validate_people(rows: DataFrame, t: Airline, as_of: Column) -> DataFrame:
    """V-05: registration rows ``(email, first, last, passport, dob, phone)`` (text) → first
    failing reason: missing field, first / last name not English, bad date of birth, under 18,
    e-mail already a member; ``ok`` otherwise."""
    req = ["email", "first", "last", "passport", "dob", "phone"]
    missing = functools.reduce(lambda a, b: a | b, [X.strip(F.coalesce(F.col(c), F.lit(""))) == "" for c in req])
    dob = F.try_to_timestamp(X.strip("dob"), F.lit("yyyy-MM-dd")).cast("date")
    members = t.member.select(F.col("Email").alias("_e")).distinct().withColumn("_member", F.lit(True))
    r = rows.withColumn("_e", X.strip("email")).join(members, "_e", "left")
    reason = (F.when(missing, "missing field")
               .when(~X.is_english_name("first"), "first name not English")
               .when(~X.is_english_name("last"), "last name not English")
               .when(dob.isNull(), "bad date of birth")
               .when(~X.is_adult(dob, as_of), "under 18")
               .when(F.col("_member").isNotNull(), "email exists")
               .otherwise("ok"))
    return r.select(*rows.columns, reason.alias("reason"))


def validate_aircraft(rows: DataFrame, t: Airline, as_of: Column) -> DataFrame:
    """V-06: aircraft configuration rows (all text: airplane_id, purchase_date, manufacturer,
    size, reg_rows, reg_cols, first_rows, first_cols) → first failing reason: missing field, bad
    date, date in the future, not numeric, too many columns, not positive, Big needs First, id
    exists; ``ok`` otherwise. First rows and columns of a Small aircraft don't count."""
    given = lambda c: X.strip(F.coalesce(F.col(c), F.lit(""))) != ""
    number = lambda c: F.when(X.strip(c).rlike(r"^[+-]?[0-9]+$"), X.strip(c).try_cast("long"))
    required = ["airplane_id", "purchase_date", "manufacturer", "size", "reg_rows", "reg_cols"]
    bought = F.try_to_timestamp(X.strip("purchase_date"), F.lit("yyyy-MM-dd")).cast("date")
    whole = {c: number(c) for c in ("airplane_id", "reg_rows", "reg_cols", "first_rows", "first_cols")}
    any_of = lambda conds: functools.reduce(lambda a, b: a | b, conds)
    no_first = any_of([F.coalesce(whole[c], F.lit(0)) <= 0 for c in ("first_rows", "first_cols")])
    known = t.airplane.select(F.col("ID").cast("long").alias("_id")).distinct().withColumn("_known", F.lit(True))
    reason = (F.when(any_of([~given(c) for c in required]), "missing field")
               .when(bought.isNull(), "bad date")
               .when(bought > F.to_date(as_of), "date in the future")
               .when(any_of([given(c) & whole[c].isNull() for c in whole]), "not numeric")
               .when(any_of([F.coalesce(whole[c], F.lit(0)) > 26 for c in ("reg_cols", "first_cols")]), "too many columns")
               .when(any_of([whole[c] <= 0 for c in ("airplane_id", "reg_rows", "reg_cols")]), "not positive")
               .when((X.strip("size") != "Small") & no_first, "Big needs First")
               .when(F.col("_known").isNotNull(), "id exists")
               .otherwise("ok"))
    return rows.withColumn("_id", whole["airplane_id"]).join(known, "_id", "left").select(*rows.columns, reason.alias("reason"))


def validate_aircrew(rows: DataFrame, t: Airline) -> DataFrame:
    """V-08: crew rows (all text: id, first, last, phone, city, street, house, start, type) → first failing
    reason: missing field, id not numeric, id not positive, first / last name not English, house number
    not numeric, house number not positive, id exists; ``ok`` otherwise."""
    required = ["id", "first", "last", "phone", "city", "street", "house", "start", "type"]
    missing = functools.reduce(lambda a, b: a | b, [X.strip(F.coalesce(F.col(c), F.lit(""))) == "" for c in required])
    number = lambda c: F.when(X.strip(c).rlike(r"^[+-]?[0-9]+$"), X.strip(c).try_cast("long"))
    known = t.aircrew.select(F.col("ID").cast("long").alias("_id")).distinct().withColumn("_known", F.lit(True))
    reason = (F.when(missing, "missing field")
               .when(number("id").isNull(), "id not numeric")
               .when(number("id") <= 0, "id not positive")
               .when(~X.is_english_name(X.strip("first")), "first name not English")
               .when(~X.is_english_name(X.strip("last")), "last name not English")
               .when(number("house").isNull(), "house number not numeric")
               .when(number("house") <= 0, "house number not positive")
               .when(F.col("_known").isNotNull(), "id exists")
               .otherwise("ok"))
    return rows.withColumn("_id", number("id")).join(known, "_id", "left").select(*rows.columns, reason.alias("reason"))


def check_seat_state(t: Airline) -> DataFrame:
    """V-07: seats held by more than one Active order, and tickets whose ``Availability``
    disagrees with their Active links (cancelled flights must be 0) → (seat key, issue)."""
    seat = ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"]
    act = order_links(t, t.booking.where(F.col("Status") == "Active"))
    per = act.groupBy(*seat).agg(F.count(F.lit(1)).alias("n_active"))
    double = per.where(F.col("n_active") > 1).select(*seat, F.lit("double sold").alias("issue"))
    canc = t.flight.where(F.col("Status") == "Canceled").select(F.col("ID").alias("Flight_ID")).withColumn("_c", F.lit(True))
    tk = t.ticket.join(per, seat, "left").join(canc, "Flight_ID", "left")
    expect = F.when(F.col("_c").isNotNull() | (F.coalesce("n_active", F.lit(0)) > 0), 0).otherwise(1)
    wrong = tk.where(F.col("Availability") != expect).select(*seat, F.lit("availability mismatch").alias("issue"))
    return double.unionByName(wrong)
