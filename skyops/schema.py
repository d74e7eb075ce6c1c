"""Explicit schemas of the airline tables (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S, L, I, D, DT, TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.DateType(), T.TimestampNTZType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


SCHEMAS: dict[str, T.StructType] = {
    "airplane": _s(("ID", L, False), ("Date_of_purchase", DT, False), ("Manufacturer", S, False), ("Size", S, False)),
    "class": _s(("Type", S, False), ("Airplane_ID", L, False), ("Number_of_rows", I, False),
                ("Number_of_columns", I, False)),
    "seat": _s(("Class_Type", S, False), ("Airplane_ID", L, False), ("Row_num", I, False), ("Column_number", S, False)),
    "flight_route": _s(("Origin_airport", S, False), ("Arrival_airport", S, False), ("Flight_duration", I, False)),
    "flight": _s(("ID", S, False), ("dep_ts", TS, False), ("arr_ts", TS, False), ("Status", S, False),
                 ("Type", S, False), ("Airplane_ID", L, False), ("Origin_airport", S, False),
                 ("Arrival_airport", S, False)),
    "booking": _s(("ID", L, False), ("Status", S, False), ("Total_price", D, False), ("Date_of_purchase", DT, False),
                  ("Cancellation_fee", D, False), ("GUEST_Email", S, True), ("MEMBER_Email", S, True)),
    "ticket_order": _s(("Airplane_ID", L, False), ("Flight_ID", S, False), ("SEAT_Row_num", I, False),
                       ("SEAT_Column_number", S, False), ("CLASS_Type", S, False), ("Order_ID", L, False)),
    "ticket": _s(("Airplane_ID", L, False), ("Flight_ID", S, False), ("SEAT_Row_num", I, False),
                 ("SEAT_Column_number", S, False), ("CLASS_Type", S, False), ("Price", D, False),
                 ("Availability", I, False)),
    "aircrew": _s(("ID", L, False), ("City", S, False), ("Street", S, False), ("House_Number", S, False),
                  ("Start_date_of_employment", DT, False), ("First_name", S, False), ("Last_name", S, False),
                  ("Phone_number", S, False), ("Type", S, False), ("Training", I, False)),
    "aircrew_assignment": _s(("Aircrew_ID", L, False), ("Flight_ID", S, False)),
    "member": _s(("Email", S, False), ("First_name_in_English", S, False), ("Last_name_in_English", S, False),
                 ("Passport_number", S, False), ("Date_of_birth", DT, False), ("Register_date", DT, False)),
    "guest": _s(("Email", S, False), ("First_name_in_English", S, False), ("Last_name_in_English", S, False)),
    "phone_number_member": _s(("Email", S, False), ("Phone_number", S, False)),
    "phone_number_guest": _s(("Email", S, False), ("Phone_number", S, False)),
    "airport": _s(("Code", S, False), ("Label", S, True)),
}
