"""Search and order-list queries (Q-01 … Q-12) and the joins they are built from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyops.functions import exprs as X
from skyops.operators import relational as Rel
from skyops.sources.airline import Airline, links_with_price

SEARCH_CAP = 200  # fixed: result cap of the flight search
SEAT5 = ["Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"]
OPEN = ("Active", "Full")


# ---- joins shared by several queries ------------------------------------------------------

def flights_with_aircraft(flight: DataFrame, airplane: DataFrame) -> DataFrame:
    """J-01: flight ⨝ airplane (aircraft is a dimension; AQE broadcasts it when small)."""
    return flight.join(airplane.select(F.col("ID").alias("Airplane_ID"), "Manufacturer", "Size"),
                       "Airplane_ID", "inner")


def links_with_tickets(ticket_order: DataFrame, ticket: DataFrame) -> DataFrame:
    """J-02: 5-column composite equi join of order links to tickets."""
    return ticket_order.join(ticket, SEAT5, "inner")


def orders_with_legs(booking: DataFrame, ticket_order: DataFrame, ticket: DataFrame, flight: DataFrame) -> DataFrame:
    """J-03: orders ⟕ links ⟕ tickets ⟕ flights (orders without tickets are kept)."""
    links = ticket_order.select("Order_ID", F.col("Order_ID").alias("link"), *SEAT5)
    tk = ticket.select(*SEAT5, F.col("Flight_ID").alias("t_flight"))
    fl = flight.select(F.col("ID").alias("t_flight"), "dep_ts", "Origin_airport", "Arrival_airport")
    return (booking.withColumnRenamed("ID", "Order_ID")
            .join(links, "Order_ID", "left")
            .join(tk, SEAT5, "left")
            .join(fl, "t_flight", "left")
            .drop("Flight_ID").withColumnRenamed("t_flight", "Flight_ID"))


def order_rollup(joined: DataFrame, keys, link_col: str = "link") -> DataFrame:
    """A-07: COUNT of the nullable link + independent MINs (each MIN is its own column)."""
    return joined.groupBy(*keys).agg(
        F.count(link_col).alias("tickets"),
        F.min("Flight_ID").alias("min_flight_id"),
        F.min("dep_ts").alias("min_dep_ts"),
        F.min(F.to_date("dep_ts")).alias("dep_date"),
        F.min(F.date_format("dep_ts", "HH:mm")).alias("dep_time"),
        F.min("Origin_airport").alias("min_origin"),
        F.min("Arrival_airport").alias("min_dest"))


def table_counts(t: Airline) -> DataFrame:
    """J-15: row counts as scalar sub-queries of one row (no join of the count frames)."""
    def n(df):
        return df.select(F.count(F.lit(1))).scalar()
    return t.airplane.sparkSession.range(1).select(
        n(t.flight).alias("flights"), n(t.booking).alias("orders"),
        n(t.aircrew).alias("aircrew"), n(t.airplane).alias("airplanes"))


def with_sellable(flights: DataFrame) -> DataFrame:
    """P-14: bookable = status Active/Full and at least one available ticket."""
    return flights.withColumn("sellable", F.coalesce(F.col("Status").isin(*OPEN)
                                                     & (F.col("available_tickets") > 0), F.lit(False)))


# ---- Q-01 / Q-02 ---------------------------------------------------------------------------

def _open_flights(t: Airline, as_of: Column, dep_date=None, origin=None, dest=None) -> DataFrame:
    f = Rel.where_status(Rel.not_departed(t.flight, as_of), OPEN)
    return Rel.where_given(f, [
        (dep_date, F.to_date("dep_ts") == F.to_date(F.lit(dep_date))),
        (origin, F.col("Origin_airport") == X.norm_code(F.lit(origin or ""))),
        (dest, F.col("Arrival_airport") == X.norm_code(F.lit(dest or ""))),
    ])


def _with_stats(f: DataFrame, t: Airline) -> DataFrame:
    st = Rel.ticket_stats(t.ticket.join(f.select(F.col("ID").alias("Flight_ID")), "Flight_ID", "left_semi"))
    out = flights_with_aircraft(f, t.airplane).join(st.withColumnRenamed("Flight_ID", "ID"), "ID", "left")
    return out.withColumn("total_tickets", F.coalesce("total_tickets", F.lit(0)).cast("long")) \
              .withColumn("available_tickets", F.coalesce("available_tickets", F.lit(0)).cast("long"))


def flight_search(t: Airline, as_of: Column, dep_date=None, origin=None, dest=None,
                  limit: int = SEARCH_CAP) -> DataFrame:
    """Q-01: open flights (not departed, Active/Full), filtered, sorted by departure and id,
    capped at ``limit``, then sold-out rows hidden.

    The cap is applied to the flights first; ticket statistics are computed only for the
    ≤ ``limit`` chosen flights (a broadcast semi-join of a bounded id set).
    """
    f = _open_flights(t, as_of, dep_date, origin, dest).orderBy("dep_ts", "ID").limit(limit)
    top = F.broadcast(f)
    out = _with_stats(top, t)
    return out.where(F.col("available_tickets") > 0).orderBy("dep_ts", "ID")


def flight_results(t: Airline, as_of: Column, dep_date=None, origin=None, dest=None) -> DataFrame:
    """Q-02: as Q-01 without the cap, sold-out rows kept, plus the bookable flag."""
    return with_sellable(_with_stats(_open_flights(t, as_of, dep_date, origin, dest), t)).orderBy("dep_ts", "ID")


# ---- Q-03 / Q-04 ---------------------------------------------------------------------------

def route_origins(t: Airline) -> DataFrame:
    """Q-03: distinct origins with their label (code when unlabelled)."""
    o = Rel.distinct_sorted(t.flight_route, ["Origin_airport"]).withColumnRenamed("Origin_airport", "code")
    return Rel.with_label(o, F.broadcast(t.airport), "code").orderBy("code")


def route_destinations(t: Airline, origin: str) -> DataFrame:
    """Q-03: destinations reachable from ``origin`` with labels."""
    d = (t.flight_route.where(F.col("Origin_airport") == X.norm_code(F.lit(origin)))
         .select(F.col("Arrival_airport").alias("code")).distinct())
    return Rel.with_label(d, F.broadcast(t.airport), "code").orderBy("code")


def available_dates(t: Airline, as_of: Column, routes: DataFrame | None = None) -> DataFrame:
    """Q-04: distinct bookable departure dates per route (all routes at once, or the given
    ``routes`` frame of (Origin_airport, Arrival_airport))."""
    f = Rel.where_status(Rel.not_departed(t.flight, as_of), OPEN)
    if routes is not None:
        f = f.join(routes.select("Origin_airport", "Arrival_airport"), ["Origin_airport", "Arrival_airport"], "left_semi")
    return (f.select("Origin_airport", "Arrival_airport", F.to_date("dep_ts").alias("d")).distinct()
            .orderBy("Origin_airport", "Arrival_airport", "d"))


# ---- Q-05 … Q-08 ---------------------------------------------------------------------------

def member_orders(t: Airline, email: str | None = None, status: str | None = None) -> DataFrame:
    """Q-05: orders of members (one member when ``email`` is given) with ticket count and the
    independent minimum date / time / origin / destination of their legs."""
    b = Rel.where_given(t.booking.where(F.col("MEMBER_Email").isNotNull()), [
        (email, F.col("MEMBER_Email") == F.lit(email)), (status, F.col("Status") == F.lit(status))])
    j = orders_with_legs(b, t.ticket_order, t.ticket, t.flight)
    r = order_rollup(j, ["MEMBER_Email", "Order_ID", "Status", "Total_price", "Date_of_purchase"])
    return r.select("MEMBER_Email", F.col("Order_ID").alias("ID"), "Status", "Total_price", "Date_of_purchase",
                    F.col("tickets").alias("tickets_count"), "dep_date", "dep_time",
                    F.col("min_origin").alias("origin"), F.col("min_dest").alias("dest")) \
            .orderBy(F.desc("Date_of_purchase"), F.desc("ID"))


def order_detail(t: Airline, as_of: Column, orders: DataFrame | None = None) -> DataFrame:
    """Q-06: ticket lines of each order with cancel eligibility.

    As in :func:`skyops.operators.booking.order_cancel`, the earliest departure of the order's
    legs counts: an Active order with lines may be cancelled when that is ≥ 36 h after ``as_of``.
    """
    b = t.booking if orders is None else t.booking.join(orders.select("ID"), "ID", "left_semi")
    links = t.ticket_order if orders is None else t.ticket_order.join(b.select(F.col("ID").alias("Order_ID")), "Order_ID", "left_semi")
    flights = t.flight.select(F.col("ID").alias("Flight_ID"), "dep_ts", "Origin_airport", "Arrival_airport", F.col("Status").alias("flight_status"))
    lines = links_with_price(t, links, flights).select("Order_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number", "Price", "Flight_ID", "dep_ts",
                                                       "Origin_airport", "Arrival_airport", "flight_status")
    # orders meet their lines in the one shuffle that also sorts them
    orders_too = lines.unionByName(b.where("ID IS NOT NULL").select(F.col("ID").alias("Order_ID"), F.struct("Status").alias("order")), allowMissingColumns=True)
    whole = Window.partitionBy("Order_ID")
    met = (orders_too.repartitionByRange("Order_ID")
           .select("*", F.min("dep_ts").over(whole).alias("first_dep"), F.collect_list("order").over(whole).alias("orders"))
           .where("order IS NULL AND Order_ID IS NOT NULL").withColumn("o", F.explode("orders"))
           .withColumn("hrs", X.hours_until(F.col("first_dep"), as_of)).withColumn("order_status", F.col("o.Status")))
    return (met.select(*lines.columns, "order_status",
                       F.coalesce((F.col("order_status") == "Active") & (F.col("hrs") >= X.CANCEL_MIN_HOURS), F.lit(False)).alias("can_cancel"),
                       F.when(F.col("order_status") != "Active", F.lit("not active"))
                        .when(F.col("hrs") < X.CANCEL_MIN_HOURS, F.lit("too late"))
                        .alias("cancel_reason"))
            .orderBy("Order_ID", "Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number"))


def order_search(t: Airline, status: str | None = None, q: str | None = None) -> DataFrame:
    """Q-07: all orders, optional status and text search (id / member / guest contains q)."""
    b = Rel.where_given(t.booking, [(status or None, F.col("Status") == F.lit(status))])
    b = Rel.search_like(b, q, [F.col("ID"), F.col("MEMBER_Email"), F.col("GUEST_Email")])
    j = orders_with_legs(b, t.ticket_order, t.ticket, t.flight)
    r = order_rollup(j, ["Order_ID", "Status", "Total_price", "Date_of_purchase", "MEMBER_Email", "GUEST_Email"])
    return r.select(F.col("Order_ID").alias("ID"), "Status", "Total_price", "Date_of_purchase", "MEMBER_Email",
                    "GUEST_Email", F.col("tickets").alias("tickets_count"), F.col("min_flight_id").alias("flight_id"),
                    "dep_date", "dep_time", F.col("min_origin").alias("origin"), F.col("min_dest").alias("dest")) \
            .orderBy(F.desc("Date_of_purchase"), F.desc("ID"))


def flight_roster(t: Airline, status: str | None = None) -> DataFrame:
    """Q-08: flights with aircraft, ticket counts and pilot / attendant name lists
    (``First Last (#id)``, ordered by crew id, NULL when none)."""
    f = Rel.where_given(t.flight, [(status or None, F.col("Status") == F.lit(status))])
    crew = t.aircrew_assignment.join(f.select(F.col("ID").alias("Flight_ID")), "Flight_ID", "left_semi") \
        .join(t.aircrew.select(F.col("ID").alias("Aircrew_ID"), "First_name", "Last_name", "Type"), "Aircrew_ID")
    label = X.crew_label(F.col("First_name"), F.col("Last_name"), F.col("Aircrew_ID"))
    pil = Rel.concat_where(crew, ["Flight_ID"], "Aircrew_ID", label, F.col("Type") == "Pilot", "pilots")
    att = Rel.concat_where(crew, ["Flight_ID"], "Aircrew_ID", label, F.col("Type") == "Flight attendant", "attendants")
    st = Rel.ticket_stats(t.ticket).select("Flight_ID", "total_tickets", "available_tickets")
    return (flights_with_aircraft(f, t.airplane)
            .join(st.withColumnRenamed("Flight_ID", "ID"), "ID", "left")
            .join(pil.withColumnRenamed("Flight_ID", "ID"), "ID", "left")
            .join(att.withColumnRenamed("Flight_ID", "ID"), "ID", "left")
            .select("ID", "dep_ts", "Status", "arr_ts", "Type", "Airplane_ID", "Origin_airport", "Arrival_airport",
                    "Size", "Manufacturer",
                    F.coalesce("total_tickets", F.lit(0)).cast("long").alias("total_tickets"),
                    F.coalesce("available_tickets", F.lit(0)).cast("long").alias("available_tickets"),
                    "pilots", "attendants")
            .orderBy(F.desc("dep_ts")))


def fleet_seats(t: Airline) -> DataFrame:
    """Q-09: aircraft with seat counts by class, Size desc (text), Manufacturer, ID."""
    return Rel.seat_counts(t.airplane, t.seat).orderBy(F.desc("Size"), "Manufacturer", "ID")


# ---- Q-10 … Q-12 ---------------------------------------------------------------------------

def bookable_check(t: Airline, as_of: Column, flight_ids: DataFrame) -> DataFrame:
    """Q-10: per requested ``Flight_ID``: not found / departed / not open / sold out / ok."""
    avail = t.ticket.groupBy("Flight_ID").agg(F.count_if(F.col("Availability") == 1).alias("available_tickets"))
    f = t.flight.select(F.col("ID").alias("Flight_ID"), "dep_ts", "Status")
    j = flight_ids.select("Flight_ID").join(f, "Flight_ID", "left").join(avail, "Flight_ID", "left")
    reason = (F.when(F.col("Status").isNull(), "not found")
               .when(F.col("dep_ts") <= as_of, "departed")
               .when(~F.col("Status").isin(*OPEN), "not open")
               .when(F.coalesce(F.col("available_tickets"), F.lit(0)) <= 0, "sold out")
               .otherwise("ok"))
    return j.select("Flight_ID", reason.alias("reason"))


def route_list(t: Airline, origin: str | None = None, dest: str | None = None) -> DataFrame:
    """Q-11: routes with duration and derived type (``> 360`` min is Long), sorted; a single
    route when both endpoints are given."""
    r = Rel.where_given(t.flight_route, [(origin, F.col("Origin_airport") == X.norm_code(F.lit(origin or ""))),
                                         (dest, F.col("Arrival_airport") == X.norm_code(F.lit(dest or "")))])
    return r.select("Origin_airport", "Arrival_airport", "Flight_duration",
                    X.flight_type("Flight_duration").alias("Type")).orderBy("Origin_airport", "Arrival_airport")


def guest_order_lookup(t: Airline, requests: DataFrame) -> DataFrame:
    """Q-12: requests (``order_text``, ``email``) → the order id when the text is a positive
    integer, the order exists, the e-mail equals its guest e-mail and it is Active;
    otherwise the first failing reason."""
    r = requests.select("order_text", "email", X.positive_int("order_text").alias("order_id"))
    b = t.booking.select(F.col("ID").alias("order_id"), "GUEST_Email", "Status")
    j = r.join(b, "order_id", "left")
    reason = (F.when(F.col("order_id").isNull(), "invalid number")
               .when(F.col("Status").isNull(), "not found")
               .when(X.strip(F.coalesce("email", F.lit(""))) == "", "email required")
               .when(~F.coalesce(F.col("GUEST_Email") == X.strip("email"), F.lit(False)), "email mismatch")
               .when(F.col("Status") != "Active", "not active")
               .otherwise("ok"))
    return j.select("order_text", "email", F.when(reason == "ok", F.col("order_id")).alias("found_order"),
                    reason.alias("reason"))
