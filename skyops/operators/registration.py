"""Checkout and the registration of aircraft, people and crew: tables of forms become checked outcomes and new rows.

Every operator returns *deltas*: the rows to insert, or the keys and new values to update, never a whole table, so what is
written follows the forms. Equal forms are one form.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyops.functions import exprs as X
from skyops.operators.booking import SEAT4, SEAT5, admit_in_rounds, asked_tickets, dense_index, held_seats, seat_generate
from skyops.operators.quality import validate_aircraft, validate_aircrew, validate_people
from skyops.session import cut_lineage
from skyops.sources.airline import Airline

FORM = ["login", "email", "first", "last", "phone"]


@dataclass
class Checkout:
    """outcomes: a row per cart; booking and links: rows to insert; sold: keys of tickets to make unavailable; members and guests: names to
    set (``is_new``: a guest to insert); phones: rows to insert, by ``kind`` (member or guest)."""

    outcomes: DataFrame
    booking: DataFrame
    links: DataFrame
    sold: DataFrame
    members: DataFrame
    guests: DataFrame
    phones: DataFrame


def _blank(*columns: str) -> Column:
    out = F.lit(False)
    for c in columns:
        out = out | (F.coalesce(F.col(c), F.lit("")) == "")
    return out


def checkout(t: Airline, forms: DataFrame, seats: DataFrame, as_of: Column) -> Checkout:
    """Carts become orders. ``forms``: ``cart_id, request_ts, order_id`` (order of arrival: request_ts, order_id, cart_id) and the buyer's ``login``
    (a member's e-mail, null for guests), ``email`` (guests), ``first``, ``last`` and ``phone``; of several forms of one cart the least counts.
    ``seats``: ``cart_id`` and the seat key.

    Reason, first failing wins: no seats → flight not found → departed → seat not available (no such ticket, not available, or sold to an
    earlier cart) → missing details → first / last name not English → no such member (a login that is none) → member must log in (a guest whose
    e-mail is a member's) → seat held (by an Active order) → ok. A cart takes all its seats or none. Carts that get as far as ``seat held`` have
    confirmed their details, so these are kept whether or not the order is made: names of the last such cart of a buyer, and all phones.
    """
    strip = [X.strip(c).alias(c) for c in FORM]
    buyers = (forms.select("cart_id", "request_ts", "order_id", *strip)
              .groupBy("cart_id").agg(F.min(F.struct("request_ts", "order_id", *FORM)).alias("_f")).select("cart_id", "_f.*"))
    lines = cut_lineage(seats.select("cart_id", *SEAT4).distinct())
    tickets = asked_tickets(t, lines)
    held = held_seats(t, lines).withColumn("_held", F.lit(True))
    per = (lines.join(t.flight.select(F.col("ID").alias("Flight_ID"), "dep_ts"), "Flight_ID", "left")
           .join(tickets.select(*SEAT4, "Availability", "Price"), SEAT4, "left").join(held, SEAT4, "left")
           .groupBy("cart_id").agg(
               F.count(F.lit(1)).alias("n_seats"), F.bool_or(F.col("dep_ts").isNull()).alias("_lost"), F.bool_or(F.col("dep_ts") <= as_of).alias("_gone"),
               F.bool_or(F.coalesce(F.col("Availability") != 1, F.lit(True))).alias("_shut"), F.bool_or(F.col("_held").isNotNull()).alias("_held"),
               F.sum("Price").alias("total")))
    is_member = t.member.select(F.col("Email").alias("_who")).distinct().withColumn("_member", F.lit(True))
    c = (buyers.withColumn("_guest", _blank("login")).withColumn("_who", F.when(F.col("_guest"), F.col("email")).otherwise(F.col("login")))
         .join(per, "cart_id", "left").join(is_member, "_who", "left"))
    known = F.col("_member").isNotNull()
    shut = (F.when(F.col("n_seats").isNull(), "no seats").when(F.col("_lost"), "flight not found").when(F.col("_gone"), "departed")
            .when(F.col("_shut"), "seat not available"))
    wrong = (F.when(_blank("first", "last", "phone", "_who"), "missing details").when(~X.is_english_name("first"), "first name not English")
             .when(~X.is_english_name("last"), "last name not English").when(~F.col("_guest") & ~known, "no such member")
             .when(F.col("_guest") & known, "member must log in"))
    every = cut_lineage(c.select("cart_id", "request_ts", "order_id", "_who", "_guest", "first", "last", "phone", "n_seats", "total", "_held",
                                 shut.alias("_shut"), wrong.alias("_wrong"), F.struct("request_ts", "order_id", "cart_id").alias("_at")))
    able = every.where(F.col("_shut").isNull() & F.col("_wrong").isNull() & ~F.col("_held"))
    won = cut_lineage(admit_in_rounds(cut_lineage(lines.join(able.select("cart_id", "n_seats", "_at"), "cart_id"))))
    taken = lines.join(won, "cart_id", "left_semi").join(every.select("cart_id", F.col("_at").alias("_first")), "cart_id").drop("cart_id")
    late = (lines.join(taken, SEAT4).join(every.select("cart_id", "_at"), "cart_id").where(F.col("_first") < F.col("_at"))
            .select("cart_id").distinct().withColumn("_late", F.lit(True)))
    done = every.join(late, "cart_id", "left").withColumn("reason", F.coalesce(
        "_shut", F.when(F.col("_late"), F.lit("seat not available")), "_wrong", F.when(F.col("_held"), F.lit("seat held")), F.lit("ok")))
    done = cut_lineage(done)

    base = t.booking.select(F.coalesce(F.max("ID"), F.lit(0)).cast("long")).scalar()
    price = X.half_up("total", 2)
    orders = dense_index(done.where("reason = 'ok'"), [F.col("request_ts"), F.col("order_id"), F.col("cart_id")]).select(
        "cart_id", (base + F.col("idx")).alias("ID"), F.lit("Active").alias("Status"), price.alias("Total_price"), F.to_date(as_of).alias("Date_of_purchase"),
        X.cancel_fee(price).alias("Cancellation_fee"), F.when(F.col("_guest"), F.col("_who")).alias("GUEST_Email"),
        F.when(~F.col("_guest"), F.col("_who")).alias("MEMBER_Email"))
    links = (lines.join(orders.select("cart_id", F.col("ID").alias("Order_ID")), "cart_id")
             .join(tickets.select(*SEAT5), SEAT4).select(*SEAT5, "Order_ID"))
    outcomes = done.join(orders.select("cart_id", "ID", "Total_price", "Cancellation_fee"), "cart_id", "left").select(
        "cart_id", "request_ts", "order_id", "reason", "ID", "Total_price", "Cancellation_fee")

    told = done.where(F.col("reason").isin("ok", "seat held"))
    names = (told.groupBy("_guest", F.col("_who").alias("Email")).agg(F.max(F.struct("_at", "first", "last")).alias("_l"))
             .select("_guest", "Email", F.col("_l.first").alias("First_name_in_English"), F.col("_l.last").alias("Last_name_in_English")))
    there = t.guest.select("Email").distinct().withColumn("_there", F.lit(True))
    guests = names.where("_guest").drop("_guest").join(there, "Email", "left").withColumn("is_new", F.col("_there").isNull()).drop("_there")
    kind = F.when(F.col("_guest"), "guest").otherwise("member")
    listed = (t.phone_number_member.withColumn("kind", F.lit("member"))
              .unionByName(t.phone_number_guest.withColumn("kind", F.lit("guest"))).select("kind", "Email", "Phone_number"))
    phones = (told.select(kind.alias("kind"), F.col("_who").alias("Email"), F.col("phone").alias("Phone_number")).distinct()
              .join(listed, ["kind", "Email", "Phone_number"], "left_anti"))
    return Checkout(outcomes, orders.drop("cart_id"), links, links.select(*SEAT5), names.where("NOT _guest").drop("_guest"), guests, phones)


def _first_form(checked: DataFrame, key: Column, columns: list[str], exists: str) -> DataFrame:
    """``checked`` (distinct forms with ``reason``) where only the least form of each key stays ``ok``; the others are refused as ``exists``. One
    partial aggregate per key, so a key that many forms share is no hot window."""
    form = F.struct(*columns)
    checked = checked.withColumn("_key", key)
    first = checked.where("reason = 'ok'").groupBy("_key").agg(F.min(form).alias("_first"))
    again = (F.col("reason") == "ok") & ~form.eqNullSafe(F.col("_first"))
    return checked.join(first, "_key", "left").withColumn("reason", F.when(again, F.lit(exists)).otherwise(F.col("reason"))).drop("_key", "_first")


def register_aircraft(rows: DataFrame, t: Airline, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Aircraft forms (those of ``validate_aircraft``) → (outcomes, airplane, class, seat): an accepted form is an aircraft, its Regular class, for all
    sizes but Small a First class, and their seats. Of several valid forms of one id the least is accepted; the others fail as ``id exists``."""
    columns = rows.columns
    number = lambda c: X.strip(c).try_cast("long")
    outcomes = _first_form(validate_aircraft(rows.distinct(), t, as_of), number("airplane_id"), columns, "id exists")
    ok = outcomes.where("reason = 'ok'")
    airplane = ok.select(number("airplane_id").alias("ID"), F.try_to_timestamp(X.strip("purchase_date"), F.lit("yyyy-MM-dd")).cast("date").alias("Date_of_purchase"),
                         X.strip("manufacturer").alias("Manufacturer"), X.strip("size").alias("Size"))
    cabin = lambda kind, r, c: F.struct(F.lit(kind).alias("Type"), number(r).cast("int").alias("Number_of_rows"), number(c).cast("int").alias("Number_of_columns"))
    cabins = F.when(X.strip("size") == "Small", F.array(cabin("Regular", "reg_rows", "reg_cols"))).otherwise(
        F.array(cabin("Regular", "reg_rows", "reg_cols"), cabin("First", "first_rows", "first_cols")))
    klass = ok.select(number("airplane_id").alias("Airplane_ID"), F.explode(cabins).alias("c")).select("c.Type", "Airplane_ID", "c.Number_of_rows", "c.Number_of_columns")
    return outcomes, airplane, klass, seat_generate(klass)


def register_people(rows: DataFrame, t: Airline, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Registration forms (those of ``validate_people``) → (outcomes, member, phone_number_member). Of several valid forms of one e-mail the least is
    accepted; the others fail as ``email exists``."""
    outcomes = _first_form(validate_people(rows.distinct(), t, as_of), X.strip("email"), rows.columns, "email exists")
    ok = outcomes.where("reason = 'ok'")
    member = ok.select(X.strip("email").alias("Email"), X.strip("first").alias("First_name_in_English"), X.strip("last").alias("Last_name_in_English"),
                       X.strip("passport").alias("Passport_number"), F.try_to_timestamp(X.strip("dob"), F.lit("yyyy-MM-dd")).cast("date").alias("Date_of_birth"),
                       F.to_date(as_of).alias("Register_date"))
    return outcomes, member, ok.select(X.strip("email").alias("Email"), X.strip("phone").alias("Phone_number"))


def register_aircrew(rows: DataFrame, t: Airline) -> tuple[DataFrame, DataFrame]:
    """Crew forms (those of ``validate_aircrew`` and ``training``: '1' or anything else) → (outcomes, aircrew). Of several valid forms of one id the least
    is accepted; the others fail as ``id exists``. A start that is no date is kept as null."""
    number = lambda c: X.strip(c).try_cast("long")
    outcomes = _first_form(validate_aircrew(rows.distinct(), t), number("id"), rows.columns, "id exists")
    text = {"City": "city", "Street": "street", "First_name": "first", "Last_name": "last", "Phone_number": "phone", "Type": "type"}
    aircrew = outcomes.where("reason = 'ok'").select(
        number("id").alias("ID"), *(X.strip(c).alias(name) for name, c in text.items()), number("house").cast("string").alias("House_Number"),
        F.try_to_timestamp(X.strip("start"), F.lit("yyyy-MM-dd")).cast("date").alias("Start_date_of_employment"),
        F.when(F.col("training") == "1", 1).otherwise(0).alias("Training"))
    return outcomes, aircrew
