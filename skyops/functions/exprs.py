"""Scalar Column expressions (F-01 … F-24). All are built-in Spark functions, so they run
inside whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values that must equal the reference's ----------------------------------------
ENGLISH_NAME_PATTERN = r"^[A-Za-z](?:[A-Za-z \-']{0,48}[A-Za-z])?$"
LONG_FLIGHT_MINUTES = 360          # > 360 min is Long, 360 is Short
CANCEL_FEE_RATE_PCT = 5            # cancellation fee, % of the total
ADULT_YEARS = 18
LOCAL_ZONE = "Asia/Jerusalem"
CANCEL_MIN_HOURS = 36              # customer cancellation needs ≥ 36 h before departure
FLIGHT_CANCEL_MIN_HOURS = 72       # flight cancellation needs ≥ 72 h before departure


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def half_up(x, n: int = 2) -> Column:
    """Round half up to ``n`` decimals as ``floor(x·10ⁿ + 0.5) / 10ⁿ`` (same text in the oracle SQL,
    so both engines produce identical doubles)."""
    scale = float(10 ** n)
    return F.floor(_c(x) * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


# F-01
def to_ts(date_col, time_col) -> Column:
    """``date || ' ' || time`` → ``TIMESTAMP_NTZ``; time is ``HH:MM`` or ``HH:MM:SS``; bad → NULL."""
    s = F.concat_ws(" ", F.trim(_c(date_col)), F.trim(_c(time_col)))
    return F.coalesce(F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm:ss")),
                      F.try_to_timestamp(s, F.lit("yyyy-MM-dd HH:mm"))).cast("timestamp_ntz")


# F-02
def month_slash(ts) -> Column:
    return F.date_format(_c(ts), "yyyy/MM")


def month_dash(ts) -> Column:
    return F.date_format(_c(ts), "yyyy-MM")


# F-03
def day(ts) -> Column:
    return F.to_date(_c(ts))


# F-04
def add_minutes(ts, n) -> Column:
    return F.timestamp_add("MINUTE", _c(n), _c(ts))


# F-05
def hours_until(ts, as_of) -> Column:
    """Fractional hours from ``as_of`` to ``ts`` (negative when ``ts`` is in the past)."""
    return F.timestamp_diff("MICROSECOND", _c(as_of), _c(ts)) / F.lit(3.6e9)


# F-06
def flight_type(minutes) -> Column:
    return F.when(_c(minutes) > LONG_FLIGHT_MINUTES, "Long").otherwise("Short")


# F-07
def hm(time_text) -> Column:
    """``HH:MM:SS`` → ``HH:MM``; NULL → ''; other text unchanged."""
    s = _c(time_text).cast("string")
    return (F.when(s.isNull(), F.lit(""))
             .when(s.rlike(r"^\d\d:\d\d(:.*)?$"), F.substring(s, 1, 5))
             .otherwise(s))


def hm_of_ts(ts) -> Column:
    return F.coalesce(F.date_format(_c(ts), "HH:mm"), F.lit(""))


# F-08
def duration_hm(minutes) -> Column:
    m = _c(minutes)
    return F.format_string("%dh %dm", F.floor(m / 60).cast("int"), (m % 60).cast("int"))


# F-09
def currency(x) -> Column:
    """``$1,234.50``; a value that is not numeric passes through as text."""
    num = (_c(x).cast("string")).try_cast("double")
    return F.coalesce(F.concat(F.lit("$"), F.format_number(num, 2)), _c(x).cast("string"))


# F-10
def crew_label(first, last, ident) -> Column:
    return F.format_string("%s %s (#%s)", _c(first), _c(last), _c(ident).cast("string"))


def route_label(origin, dest) -> Column:
    return F.concat_ws("-", _c(origin), _c(dest))


def plane_label(manufacturer, size) -> Column:
    return F.format_string("%s (%s)", _c(manufacturer), _c(size))


#: fixed value: the characters that count as white space at the ends of form fields
WHITE_SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def strip(x) -> Column:
    """Text without white space at both ends: tabs, line ends and Unicode spaces too, unlike ``trim``."""
    return F.regexp_replace(_c(x).cast("string"), f"^{WHITE_SPACE}|{WHITE_SPACE}\\z", "")


# F-11
def is_english_name(x) -> Column:
    t = strip(F.coalesce(_c(x).cast("string"), F.lit("")))
    return (t != "") & t.rlike(ENGLISH_NAME_PATTERN)


# F-12
def positive_int(x) -> Column:
    """ASCII digits only (after :func:`strip`) and > 0 → the number, else NULL."""
    t = strip(x)
    n = (t).try_cast("long")
    return F.when(t.rlike(r"^[0-9]+$") & (n > 0), n)


# F-13
def adult_cutoff(as_of) -> Column:
    """``as_of`` date minus 18 years; Feb 29 becomes Feb 28 (``add_months`` clamps)."""
    return F.add_months(F.to_date(_c(as_of)), -12 * ADULT_YEARS)


def is_adult(dob, as_of) -> Column:
    return _c(dob) <= adult_cutoff(as_of)


# F-14
def flight_code(n) -> Column:
    return F.format_string("F%05d", _c(n).cast("long"))


def flight_no(code) -> Column:
    """Leading digits behind the ``F`` of a flight id; 0 without them, and for ids that don't start with ``F``."""
    return F.when(_c(code).startswith("F"), lenient_int(F.substring(_c(code), 2, 1 << 20))).otherwise(F.lit(0).cast("long"))


# F-15
def col_letter(n) -> Column:
    """1 → 'A' … 26 → 'Z'."""
    return F.char(F.lit(64) + _c(n).cast("long"))


# F-16
def parse_seat_key(key) -> Column:
    """``cls|row|col`` → struct(cls, row, col); malformed → NULL struct."""
    parts = F.split(_c(key), r"\|")
    row = (F.get(parts, 1)).try_cast("int")
    ok = (F.size(parts) == 3) & row.isNotNull() & (F.length(F.get(parts, 0)) > 0) & (F.length(F.get(parts, 2)) > 0)
    return F.when(ok, F.struct(F.get(parts, 0).alias("cls"), row.alias("row"), F.get(parts, 2).alias("col")))


# F-17
def seat_label(col_letter_, row) -> Column:
    return F.concat(_c(col_letter_), _c(row).cast("string"))


def status_slug(status) -> Column:
    return F.lower(F.translate(_c(status), " ", "-"))


# F-18
def cancel_fee(total) -> Column:
    """5 % of the total in whole cents, half up: ``floor(total·5 + 0.5) / 100``."""
    return F.floor(_c(total) * F.lit(float(CANCEL_FEE_RATE_PCT)) + F.lit(0.5)) / F.lit(100.0)


# F-19
def local_ts(utc_ts) -> Column:
    """UTC wall clock → Asia/Jerusalem wall clock (``TIMESTAMP_NTZ`` in, ``TIMESTAMP_NTZ`` out)."""
    return F.from_utc_timestamp(_c(utc_ts).cast("timestamp"), LOCAL_ZONE).cast("timestamp_ntz")


# F-20 (metadata only) — fixed report header labels
HEADER_MAP = {
    "avg_occupancy_percentage": "Average occupancy (%)",
    "occupancy_percentage": "Occupancy (%)",
    "Cancellation_Rate": "Cancellation rate (%)",
    "Total_Income": "Total income ($)",
    "Flights_Executed": "Flights executed",
    "Flights_Canceled": "Flights canceled",
    "flights_done": "Flights executed",
    "flights_canceled": "Flights canceled",
    "utilization_pct": "Utilization (%)",
    "dominant_route": "Dominant route",
    "CLASS_Type": "Class type",
    "Airplane_ID": "Airplane ID",
    "Aircrew_ID": "Aircrew ID",
    "Flight_ID": "Flight ID",
}


def pretty_header(name: str) -> str:
    """Report header: fixed label, else ``_`` → space, Title Case, ``Id`` → ``ID``, ``Ym`` → ``Month``."""
    if name in HEADER_MAP:
        return HEADER_MAP[name]
    words = [w[:1].upper() + w[1:].lower() for w in name.split("_") if w]
    out = []
    for w in words:
        if w == "Id":
            out.append("ID")
        elif w == "Ym":
            out.append("Month")
        else:
            out.append(w)
    return " ".join(out)


def pretty_headers(df):
    return df.toDF(*[pretty_header(c) for c in df.columns])


# F-21
def norm_code(x) -> Column:
    return F.upper(F.trim(_c(x)))


# F-22
def or_default(x, v) -> Column:
    return F.coalesce(_c(x), F.lit(v))


def lenient_int(x) -> Column:
    """SQLite-style ``CAST(x AS INTEGER)``: leading integer text, else 0."""
    lead = F.regexp_extract(F.trim(_c(x).cast("string")), r"^[+-]?\d+", 0)
    return F.coalesce((lead).try_cast("long"), F.lit(0).cast("long"))


# F-23
def buyer_kind(member_email, guest_email) -> Column:
    return F.when(_c(member_email).isNotNull(), "Member").otherwise("Guest")


# F-24
def clamp_qty(qty, available) -> Column:
    """``min(max(1, qty), available)``; a quantity that is not an integer counts as 1."""
    q = F.coalesce((_c(qty).cast("string")).try_cast("int"), F.lit(1))
    return F.least(F.greatest(F.lit(1), q), _c(available).cast("int"))
