"""Set-at-a-time booking, cancellation, status refresh and generation (D-01, D-09 … D-16).

The reference runs these as one-request transactions against SQLite. Here each takes a
table of requests and returns new frames (copy-on-write; persist by writing to a new
path). Decisions that depend on arrival order are made with ordered aggregates keyed by
seat, never by collecting a flight's requests into one task.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyops.functions import exprs as X
from skyops.session import cut_lineage
from skyops.sources.airline import Airline, order_links

SEAT4 = ["Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number"]
SEAT5 = ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"]
OPEN = ("Active", "Full")
MAX_COLUMNS = 26   # seat letters A..Z


# ---- helpers -------------------------------------------------------------------------------

def dense_index(df: DataFrame, order: list[Column], out: str = "idx") -> DataFrame:
    """1-based consecutive index over ``df`` in ``order``: rows are range-partitioned and sorted by
    ``order``, numbered within their partition, and shifted by the sizes of the partitions before
    (a table of one row per partition). The numbered rows are checkpointed, so a lost executor
    can't renumber them."""
    d = df.repartitionByRange(*order).sortWithinPartitions(*order)
    d = cut_lineage(d.select("*", F.spark_partition_id().alias("_bk"),
                             (F.monotonically_increasing_id() % F.lit(1 << 33)).alias("_loc")))
    sizes = d.groupBy("_bk").agg(F.count(F.lit(1)).alias("_n"))
    off = sizes.select("_bk", F.coalesce(F.sum("_n").over(
        Window.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    return d.join(off, "_bk").withColumn(out, (F.col("_off") + F.col("_loc") + 1).cast("long")) \
            .drop("_bk", "_loc", "_off")


def active_links(t: Airline, booking: DataFrame | None = None) -> DataFrame:
    b = t.booking if booking is None else booking
    return order_links(t, b.where(F.col("Status") == "Active"))


def asked_tickets(t: Airline, seats: DataFrame) -> DataFrame:
    """The tickets of ``seats`` (the seat key), and only those, written once: flights nobody asks for drop out before their tickets are formed."""
    asked = seats.select(*SEAT4).distinct()
    flights = asked.select("Flight_ID").distinct()
    return cut_lineage(t.ticket.join(flights, "Flight_ID", "left_semi").join(asked, SEAT4, "left_semi").select(*SEAT5, "Availability", "Price"))


def held_seats(t: Airline, seats: DataFrame) -> DataFrame:
    """Those of ``seats`` that an Active order holds, distinct."""
    asked = seats.select(*SEAT4).distinct()
    links = active_links(t).join(asked.select("Flight_ID").distinct(), "Flight_ID", "left_semi")
    return links.select(*SEAT4).join(asked, SEAT4, "left_semi").distinct()


# ---- D-01 ----------------------------------------------------------------------------------

def status_refresh(t: Airline, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Flights Active/Full that departed by ``as_of`` → Completed; Active orders with any ticket
    on a departed flight (whatever its status) → Completed. Cancelled orders are untouched."""
    flight = t.flight.withColumn("Status", F.when(F.col("Status").isin(*OPEN) & (F.col("dep_ts") <= as_of),
                                                  F.lit("Completed")).otherwise(F.col("Status")))
    gone = t.ticket_order.join(t.flight.where(F.col("dep_ts") <= as_of).select(F.col("ID").alias("Flight_ID")),
                               "Flight_ID", "left_semi").select(F.col("Order_ID").alias("ID")).distinct() \
        .withColumn("_gone", F.lit(True))
    booking = (t.booking.join(gone, "ID", "left")
               .withColumn("Status", F.when((F.col("Status") == "Active") & F.col("_gone").isNotNull(),
                                            F.lit("Completed")).otherwise(F.col("Status"))).drop("_gone"))
    return flight, booking


# ---- D-09 ----------------------------------------------------------------------------------

def seat_admission(t: Airline, requests: DataFrame, extra_held: DataFrame | None = None) -> DataFrame:
    """First admissible request per seat wins. A seat is admissible when the ticket exists,
    has ``Availability = 1`` and no Active link (nor a seat in ``extra_held``, e.g. seats
    accepted by earlier micro-batches). Ties in ``request_ts`` go to the smaller
    ``order_id``. → requests + ``accepted`` + ``reason``."""
    tk = t.ticket.select(*SEAT5, "Availability", "Price")
    held = active_links(t).select(*SEAT4)
    if extra_held is not None:
        held = held.unionByName(extra_held.select(*SEAT4))
    # only the seats that are asked for
    held = held.join(requests.select(*SEAT4), SEAT4, "left_semi").distinct().withColumn("_held", F.lit(True))
    r = requests.join(tk, SEAT4, "left").join(held, SEAT4, "left")
    pre = (F.when(F.col("Availability").isNull(), "no such seat")
            .when(F.col("Availability") != 1, "unavailable")
            .when(F.col("_held").isNotNull(), "held"))
    r = r.withColumn("_pre", pre)
    # the winner of each seat among admissible requests: one min aggregate per seat (partial
    # aggregation makes a hot seat cheap)
    win = (r.where(F.col("_pre").isNull()).groupBy(*SEAT4)
           .agg(F.min(F.struct("request_ts", "order_id")).alias("_w")))
    r = r.join(win, SEAT4, "left")
    mine = F.struct("request_ts", "order_id") == F.col("_w")
    reason = F.coalesce(F.col("_pre"), F.when(mine, F.lit("ok")).otherwise(F.lit("taken")))
    return r.withColumn("reason", reason).withColumn("accepted", F.col("reason") == "ok") \
            .drop("_pre", "_held", "_w", "Availability")


# ---- D-10 ----------------------------------------------------------------------------------

def cart_admission(t: Airline, carts: DataFrame, tickets: DataFrame | None = None) -> DataFrame:
    """All-or-nothing carts. ``carts`` has one row per requested seat with ``cart_id``,
    ``request_ts``, ``order_id`` and the seat key. A cart is its ``cart_id``; its instant and order
    are the smallest of its rows. A cart precedes another by (request_ts, order_id, cart_id).

    A cart is accepted iff all of its seats are admissible (exist, available, not held) and
    none was taken by an earlier accepted cart; a rejected cart takes no seat (rollback).
    → cart_id, request_ts, order_id, valid (its seats are admissible), n_seats, accepted. ``tickets`` as in :func:`order_create`.

    Carts with an inadmissible seat are rejected before the first round. The others are decided in
    rounds: a pending cart is *ready* when it is the earliest pending cart of every seat it asks for.
    Ready carts never share a seat, and the earliest pending cart is always ready, so every round
    decides some and the rounds end; there are as many as the longest chain of carts that wait for
    each other. A round drops the decided carts and all carts that ask for a seat just taken, and
    writes only what is still pending; no flight's carts are gathered into one task.
    """
    carts = cut_lineage(carts.select("cart_id", "request_ts", "order_id", *SEAT4))
    seats = cut_lineage(carts.select("cart_id", *SEAT4).distinct())
    tk = (asked_tickets(t, seats) if tickets is None else tickets).select(*SEAT4, "Availability")
    held = held_seats(t, seats).withColumn("_held", F.lit(True))
    checked = (seats.join(tk, SEAT4, "left").join(held, SEAT4, "left")
               .withColumn("_ok", F.coalesce((F.col("Availability") == 1) & F.col("_held").isNull(), F.lit(False))))
    order = carts.groupBy("cart_id").agg(F.min("request_ts").alias("request_ts"), F.min("order_id").alias("order_id"))
    every = cut_lineage(order.join(checked.groupBy("cart_id").agg(F.every("_ok").alias("valid"), F.count(F.lit(1)).alias("n_seats")), "cart_id")
                        .select("cart_id", "request_ts", "order_id", "valid", "n_seats"))
    place = F.struct("request_ts", "order_id", "cart_id").alias("_at")
    waiting = cut_lineage(seats.join(every.where("valid").select("cart_id", "n_seats", place), "cart_id"))
    yes = admit_in_rounds(waiting).withColumn("accepted", F.lit(True))
    return every.join(yes, "cart_id", "left").withColumn("accepted", F.coalesce("accepted", F.lit(False))) \
        .select("cart_id", "request_ts", "order_id", "valid", "n_seats", "accepted")


def admit_in_rounds(waiting: DataFrame) -> DataFrame:
    """``cart_id`` of the carts that win all their seats. ``waiting``: a row per cart and seat, with ``n_seats`` and the cart's place ``_at``;
    the rounds are those of :func:`cart_admission`."""
    accepted = []
    while not waiting.isEmpty():
        first = waiting.groupBy(*SEAT4).agg(F.min("_at").alias("_first"))
        ready = (waiting.join(first, SEAT4).where(F.col("_first") == F.col("_at"))
                 .groupBy("cart_id", "n_seats").agg(F.count(F.lit(1)).alias("_m")).where("_m = n_seats"))
        won = cut_lineage(ready.select("cart_id"))
        accepted.append(won)
        taken = waiting.join(won, "cart_id", "left_semi").select(*SEAT4)
        out = waiting.join(taken, SEAT4, "left_semi").select("cart_id").distinct()
        waiting = cut_lineage(waiting.join(out, "cart_id", "left_anti"))
    return functools.reduce(DataFrame.union, accepted) if accepted else waiting.select("cart_id")


# ---- D-11 ----------------------------------------------------------------------------------

def order_create(t: Airline, accepted: DataFrame, as_of: Column, tickets: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From accepted carts (one row per seat with ``cart_id``, ``request_ts``, ``order_id``
    (request order, not the new id), ``email`` and the seat key) build the new orders, their
    ticket links and the updated tickets. New ids are ``max(ID) + 1 …`` in request order.
    ``tickets``: the tickets of these seats or of more, where they are at hand (:func:`asked_tickets`)."""
    accepted = cut_lineage(accepted)
    tk = (asked_tickets(t, accepted) if tickets is None else tickets).select(*SEAT5, "Price")
    lines = cut_lineage(accepted.join(tk, SEAT4, "inner"))
    carts = lines.groupBy("cart_id", "request_ts", "order_id").agg(
        F.sum("Price").alias("total"), F.min("email").alias("email"))
    base = t.booking.select(F.coalesce(F.max("ID"), F.lit(0)).cast("long")).scalar()
    carts = dense_index(carts, [F.col("request_ts"), F.col("order_id"), F.col("cart_id")]).withColumn("ID", base + F.col("idx"))
    is_member = carts.join(t.member.select(F.col("Email").alias("email")), "email", "left_semi") \
                     .select("cart_id").withColumn("_m", F.lit(True))
    c = carts.join(is_member, "cart_id", "left")
    booking_new = c.select(
        "ID", F.lit("Active").alias("Status"), X.half_up("total", 2).alias("Total_price"),
        F.to_date(as_of).alias("Date_of_purchase"), X.cancel_fee(X.half_up("total", 2)).alias("Cancellation_fee"),
        F.when(F.col("_m").isNull(), F.col("email")).alias("GUEST_Email"),
        F.when(F.col("_m").isNotNull(), F.col("email")).alias("MEMBER_Email"))
    links = lines.join(carts.select("cart_id", "ID"), "cart_id").select(*SEAT5, F.col("ID").alias("Order_ID"))
    sold = links.select(*SEAT5).distinct().withColumn("_sold", F.lit(True))
    ticket_new = t.ticket.join(sold, SEAT5, "left").withColumn(
        "Availability", F.when(F.col("_sold").isNotNull(), F.lit(0)).otherwise(F.col("Availability"))).drop("_sold")
    return booking_new, links, ticket_new


# ---- D-12 ----------------------------------------------------------------------------------

def order_cancel(t: Airline, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Customer cancellation of a table of requests ``(request_ts, order_id, req_member,
    req_guest)`` — the requester's member e-mail or guest e-mail.

    Outcome reason, first failing wins: not found → not owner (member e-mail must equal the
    order's member e-mail, or the guest e-mail its guest e-mail; NULL never matches) → no
    tickets → less than 36 h before the earliest departure of the order → not active (also
    when an earlier request of this batch has cancelled the order; refused requests change nothing). An accepted order
    becomes ``Customer Cancellation`` with ``Total_price`` = its stored fee (5 % of the total
    when the fee is ≤ 0); each of its seats becomes available iff no *other* Active link
    remains after the whole batch. → (booking, ticket, outcomes)
    """
    b = t.booking
    legs = (t.ticket_order.join(t.flight.select(F.col("ID").alias("Flight_ID"), "dep_ts"), "Flight_ID")
            .groupBy("Order_ID").agg(F.min("dep_ts").alias("_first_dep")))
    r = (requests.join(b.select(F.col("ID").alias("order_id"), "Status", "MEMBER_Email", "GUEST_Email",
                                "Total_price", "Cancellation_fee"), "order_id", "left")
         .join(legs.withColumnRenamed("Order_ID", "order_id"), "order_id", "left"))
    owner = (F.coalesce(F.col("MEMBER_Email") == F.col("req_member"), F.lit(False))
             | F.coalesce((X.strip(F.coalesce("req_guest", F.lit(""))) != "")
                          & (F.col("GUEST_Email") == F.col("req_guest")), F.lit(False)))
    reason = (F.when(F.col("Status").isNull(), "not found")
               .when(~owner, "not owner")
               .when(F.col("_first_dep").isNull(), "no tickets")
               .when(X.hours_until("_first_dep", as_of) < X.CANCEL_MIN_HOURS, "too late")
               .when(F.col("Status") != "Active", "not active")
               .otherwise("ok"))
    r = r.withColumn("_alone", reason)  # the request by itself
    first = F.row_number().over(Window.partitionBy("order_id", "_alone").orderBy("request_ts", "req_member", "req_guest"))
    outcomes = r.withColumn("reason", F.when((F.col("_alone") == "ok") & (first > 1), "not active").otherwise(F.col("_alone"))).withColumn("accepted", F.col("reason") == "ok")
    ok = outcomes.where("accepted").select(F.col("order_id").alias("ID")).distinct().withColumn("_c", F.lit(True))
    fee = F.when(F.coalesce(F.col("Cancellation_fee"), F.lit(0.0)) > 0, F.col("Cancellation_fee")) \
           .otherwise(X.cancel_fee(F.coalesce(F.col("Total_price"), F.lit(0.0))))
    booking = (b.join(ok, "ID", "left")
               .withColumn("Total_price", F.when(F.col("_c").isNotNull(), fee).otherwise(F.col("Total_price")))
               .withColumn("Status", F.when(F.col("_c").isNotNull(), F.lit("Customer Cancellation"))
                           .otherwise(F.col("Status"))).drop("_c"))
    touched = t.ticket_order.join(ok.withColumnRenamed("ID", "Order_ID"), "Order_ID", "left_semi") \
        .select(*SEAT5).distinct()
    still = active_links(t, booking).select(*SEAT5).distinct().withColumn("_still", F.lit(True))
    upd = touched.join(still, SEAT5, "left").select(
        *SEAT5, F.when(F.col("_still").isNotNull(), 0).otherwise(1).alias("_av"))
    ticket = t.ticket.join(upd, SEAT5, "left").withColumn(
        "Availability", F.coalesce(F.col("_av"), F.col("Availability"))).drop("_av")
    return booking, ticket, outcomes.select("request_ts", "order_id", "req_member", "req_guest", "reason",
                                            "accepted")


# ---- D-13 ----------------------------------------------------------------------------------

def flight_cancel(t: Airline, requests: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Manager cancellation of flights ``(Flight_ID)`` at least 72 h before departure (the
    flight status is not checked): flight → Canceled; its Active orders → System Cancellation
    with price 0 and fee 0; all its tickets unavailable; links kept.
    → (flight, booking, ticket, outcomes)"""
    f = t.flight.select(F.col("ID").alias("Flight_ID"), "dep_ts")
    r = requests.select("Flight_ID").distinct().join(f, "Flight_ID", "left")
    reason = (F.when(F.col("dep_ts").isNull(), "not found")
               .when(X.hours_until("dep_ts", as_of) < X.FLIGHT_CANCEL_MIN_HOURS, "too late")
               .otherwise("ok"))
    outcomes = r.select("Flight_ID", reason.alias("reason"))
    ok = outcomes.where(F.col("reason") == "ok").select("Flight_ID").withColumn("_x", F.lit(True))
    flight = t.flight.join(ok.withColumnRenamed("Flight_ID", "ID"), "ID", "left") \
        .withColumn("Status", F.when(F.col("_x").isNotNull(), F.lit("Canceled")).otherwise(F.col("Status"))).drop("_x")
    hit = t.ticket_order.join(ok, "Flight_ID", "left_semi").select(F.col("Order_ID").alias("ID")).distinct() \
        .withColumn("_h", F.lit(True))
    sysc = (F.col("_h").isNotNull()) & (F.col("Status") == "Active")
    booking = (t.booking.join(hit, "ID", "left")
               .withColumn("Total_price", F.when(sysc, F.lit(0.0)).otherwise(F.col("Total_price")))
               .withColumn("Cancellation_fee", F.when(sysc, F.lit(0.0)).otherwise(F.col("Cancellation_fee")))
               .withColumn("Status", F.when(sysc, F.lit("System Cancellation")).otherwise(F.col("Status")))
               .drop("_h"))
    ticket = t.ticket.join(ok, "Flight_ID", "left").withColumn(
        "Availability", F.when(F.col("_x").isNotNull(), F.lit(0)).otherwise(F.col("Availability"))).drop("_x")
    return flight, booking, ticket, outcomes


# ---- D-14 … D-16 ---------------------------------------------------------------------------

def _seat_reason() -> Column:
    """Why a class row has no seats; NULL when it has."""
    bad = F.coalesce((F.col("Number_of_rows") < 1) | (F.col("Number_of_columns") < 1), F.lit(True))
    return (F.when(F.coalesce(F.col("Number_of_columns") > MAX_COLUMNS, F.lit(False)), "too many columns")
             .when(bad, "no rows or columns"))


def seat_generate(classes: DataFrame) -> DataFrame:
    """Seats of each class row ``(Airplane_ID, Type, Number_of_rows, Number_of_columns)``:
    rows × columns with letters A…; the other class rows are :func:`seat_rejected`."""
    return (classes.where(_seat_reason().isNull())
            .withColumn("Row_num", F.explode(F.sequence(F.lit(1), F.col("Number_of_rows"))))
            .withColumn("_c", F.explode(F.sequence(F.lit(1), F.col("Number_of_columns"))))
            .select(F.col("Type").alias("Class_Type"), "Airplane_ID", "Row_num",
                    X.col_letter(F.col("_c")).alias("Column_number")))


def seat_rejected(classes: DataFrame) -> DataFrame:
    """Class rows without seats, with the ``reason``."""
    return classes.withColumn("reason", _seat_reason()).where(F.col("reason").isNotNull())


def ticket_generate(flights: DataFrame, seat: DataFrame) -> DataFrame:
    """One ticket per seat of each new flight ``(Flight_ID, Airplane_ID, price_regular,
    price_first)``; First falls back to the Regular price; all available."""
    s = seat.select("Airplane_ID", F.col("Row_num").alias("SEAT_Row_num"),
                    F.col("Column_number").alias("SEAT_Column_number"), F.col("Class_Type").alias("CLASS_Type"))
    return flights.join(s, "Airplane_ID").select(
        *SEAT5, F.when(F.col("CLASS_Type") == "First", F.coalesce("price_first", "price_regular"))
        .otherwise(F.col("price_regular")).alias("Price"), F.lit(1).alias("Availability"))


def flight_plan(t: Airline, requests: DataFrame) -> DataFrame:
    """New-flight requests ``(dep_ts, Origin_airport, Arrival_airport, Airplane_ID)`` → type,
    arrival instant and the next ids ``F#####`` (max numeric suffix + request order), ``reason`` ``ok``.
    Requests on a route that does not exist come back without id, arrival and type, ``reason`` ``no such route``."""
    keys = ["Origin_airport", "Arrival_airport"]
    known = requests.join(t.flight_route, keys)
    base = t.flight.select(F.coalesce(F.max(X.flight_no("ID")), F.lit(0)).cast("long")).scalar()
    r = dense_index(known, [F.col("dep_ts"), F.col("Origin_airport"), F.col("Arrival_airport"), F.col("Airplane_ID")])
    planned = r.select(X.flight_code(base + F.col("idx")).alias("ID"), "dep_ts",
                       X.add_minutes("dep_ts", "Flight_duration").alias("arr_ts"), F.lit("Active").alias("Status"),
                       X.flight_type("Flight_duration").alias("Type"), "Airplane_ID", *keys, F.lit("ok").alias("reason"))
    refused = requests.join(t.flight_route, keys, "left_anti").select(
        F.lit(None).cast("string").alias("ID"), "dep_ts", F.lit(None).cast("timestamp_ntz").alias("arr_ts"), F.lit(None).cast("string").alias("Status"),
        F.lit(None).cast("string").alias("Type"), "Airplane_ID", *keys, F.lit("no such route").alias("reason"))
    return planned.unionByName(refused)
