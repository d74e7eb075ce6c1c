"""Airline tables derived from the driver's TPC-H-style parquet tables.

The derivation rules are the fixture definitions of FIXTURES.md §C, written with the
DataFrame API (the DuckDB oracle uses an independent SQL text of the same rules,
see :mod:`skyops.sources.oracle_views`). All frames are lazy; Catalyst prunes the
columns and pushes filters down to the parquet scans.

Scale notes
-----------
* ``airplane``/``class``/``seat`` grow with ``supplier``; ``flight_route`` is bounded by
  the fixed-size ``nation`` dimension (all ordered pairs of distinct nations).
* ``flight`` grows with ``part``, ``booking`` with ``orders``, ``ticket_order`` with
  ``lineitem`` and ``ticket`` with ``flight`` x seats-per-aircraft (≤ 50).
* Joins to ``flight_route`` carry an equi key on both airports; that side has a proven
  bound (≤ |nation|²) and is broadcast. Every other join is an equi join between
  growing tables and is left to the planner (AQE picks broadcast only when the
  measured side is small).
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the fixture derivation (FIXTURES.md §C).
AS_OF_FIXTURE = "2001-01-01 00:00:00"
FLIGHT_EPOCH = "1999-01-01 00:00:00"
SEAT_LETTERS = "ABCDEF"
REGULAR_ROWS, REGULAR_COLS = 7, 6
FIRST_ROWS, FIRST_COLS = 2, 4

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")


def ts_ntz(text: str) -> Column:
    """A ``TIMESTAMP_NTZ`` literal."""
    return F.to_timestamp_ntz(F.lit(text))


def flight_code_of(partkey: Column) -> Column:
    """``F`` and the part key, padded to seven digits and never cut — fixture flight id."""
    return F.format_string("F%07d", partkey.cast("bigint"))


def seat_letter(n: Column) -> Column:
    """1 → 'A', …, 6 → 'F' (position in ``SEAT_LETTERS``)."""
    return F.substring(F.lit(SEAT_LETTERS), n.cast("int"), F.lit(1))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


@dataclass
class Airline:
    """Namespace of the airline tables (lazy DataFrames)."""

    airplane: DataFrame
    klass: DataFrame  # CLASS (``class`` is a Python keyword)
    seat: DataFrame
    flight_route: DataFrame
    flight: DataFrame
    booking: DataFrame  # ORDER
    ticket_order: DataFrame
    ticket: DataFrame
    aircrew: DataFrame
    aircrew_assignment: DataFrame
    member: DataFrame
    guest: DataFrame
    phone_number_member: DataFrame
    phone_number_guest: DataFrame
    airport: DataFrame  # airport code → display label (a small dimension)

    def tables(self) -> dict[str, DataFrame]:
        out = {f.name: getattr(self, f.name) for f in fields(self)}
        out["class"] = out.pop("klass")
        return out

    def raw(self, name: str) -> DataFrame:
        """A driver table of the directory these tables were derived from."""
        return _read(self.airplane.sparkSession, self.sf_dir, name)

    def register(self, prefix: str = "") -> None:
        """Register every table as a temp view (``class`` keeps its domain name)."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(prefix + name)


def derive(spark: SparkSession, sf_dir: str) -> Airline:
    """Build the airline tables from the driver tables under ``sf_dir``."""
    supplier = _read(spark, sf_dir, "supplier")
    nation = _read(spark, sf_dir, "nation")
    part = _read(spark, sf_dir, "part")
    orders = _read(spark, sf_dir, "orders")
    lineitem = _read(spark, sf_dir, "lineitem")
    customer = _read(spark, sf_dir, "customer")

    airplane = supplier.select(
        F.col("s_suppkey").alias("ID"),
        F.to_date(F.lit("1990-01-01")).alias("Date_of_purchase"),
        F.when(F.col("s_nationkey") % 3 == 0, "Boeing")
         .when(F.col("s_nationkey") % 3 == 1, "Airbus")
         .otherwise("Dassault").alias("Manufacturer"),
        F.when(F.col("s_suppkey") % 2 == 0, "Big").otherwise("Small").alias("Size"),
    )

    klass = airplane.select(
        F.lit("Regular").alias("Type"), F.col("ID").alias("Airplane_ID"),
        F.lit(REGULAR_ROWS).alias("Number_of_rows"), F.lit(REGULAR_COLS).alias("Number_of_columns"),
    ).unionByName(airplane.where(F.col("Size") == "Big").select(
        F.lit("First").alias("Type"), F.col("ID").alias("Airplane_ID"),
        F.lit(FIRST_ROWS).alias("Number_of_rows"), F.lit(FIRST_COLS).alias("Number_of_columns"),
    ))

    # seats = rows x columns of each class, generated per class row (no join needed)
    seat = (klass
            .withColumn("Row_num", F.explode(F.sequence(F.lit(1), F.col("Number_of_rows"))))
            .withColumn("c", F.explode(F.sequence(F.lit(1), F.col("Number_of_columns"))))
            .select(F.col("Type").alias("Class_Type"), "Airplane_ID", "Row_num",
                    seat_letter(F.col("c")).alias("Column_number")))

    # all ordered pairs of distinct nations: a cross product of the 25 rows that the nation
    # dimension has at every scale, formed from one array
    ns = nation.agg(F.collect_list(F.struct(F.col("n_nationkey").alias("k"),
                                            F.col("n_name").alias("name"))).alias("ns"))
    route_keys = (ns.select(F.explode("ns").alias("a"), "ns")
                    .select("a", F.explode("ns").alias("b"))
                    .where(F.col("a.k") != F.col("b.k"))
                    .select(F.col("a.k").alias("o_key"), F.col("b.k").alias("a_key"),
                            F.col("a.name").alias("Origin_airport"),
                            F.col("b.name").alias("Arrival_airport"),
                            (F.lit(60) + (F.col("a.k") * 37 + F.col("b.k") * 53) % 600)
                            .cast("int").alias("Flight_duration")))
    flight_route = route_keys.select("Origin_airport", "Arrival_airport", "Flight_duration")

    n_sup = supplier.select(F.count(F.lit(1))).scalar()
    pk = F.col("p_partkey")
    minutes = ((pk % 1095) * 1440 + (pk % 24) * 60 + (pk % 12) * 5).cast("int")
    flight_base = part.select(
        "p_partkey", "p_size", "p_retailprice",
        (pk % n_sup).alias("Airplane_ID"),
        (pk % 25).cast("int").alias("o_key"),
        ((pk % 25 + 1 + F.col("p_size") % 24) % 25).cast("int").alias("a_key"),
        F.timestamp_add("MINUTE", minutes, ts_ntz(FLIGHT_EPOCH)).alias("dep_ts"),
    )
    fb = flight_base.join(route_keys, ["o_key", "a_key"], "inner")
    flight = fb.select(
        flight_code_of(F.col("p_partkey")).alias("ID"),
        "dep_ts",
        F.timestamp_add("MINUTE", F.col("Flight_duration"), F.col("dep_ts")).alias("arr_ts"),
        F.when(F.col("p_size") % 10 == 0, "Canceled")
         .when(F.col("dep_ts") <= ts_ntz(AS_OF_FIXTURE), "Completed")
         .when(F.col("p_size") % 10 == 1, "Full")
         .otherwise("Active").alias("Status"),
        F.when(F.col("Flight_duration") > 360, "Long").otherwise("Short").alias("Type"),
        "Airplane_ID", "Origin_airport", "Arrival_airport", "p_retailprice",
    )

    ck = F.col("o_custkey")
    booking = orders.select(
        F.col("o_orderkey").alias("ID"),
        F.when(F.col("o_orderstatus") == "F", "Completed")
         .when(F.col("o_orderstatus") == "O", "Active")
         .when(F.col("o_orderkey") % 2 == 0, "Customer Cancellation")
         .otherwise("System Cancellation").alias("Status"),
        F.col("o_totalprice").alias("Total_price"),
        F.to_date("o_orderdate").alias("Date_of_purchase"),
        (F.floor(F.col("o_totalprice") * 5 + F.lit(0.5)) / F.lit(100.0)).alias("Cancellation_fee"),
        F.when((ck % 3 == 0) & (ck % 30 != 0),
               F.concat(F.lit("g"), ck.cast("string"), F.lit("@example.com"))).alias("GUEST_Email"),
        F.when(ck % 3 != 0,
               F.concat(F.lit("m"), ck.cast("string"), F.lit("@example.com"))).alias("MEMBER_Email"),
    )

    # flight id and aircraft are functions of the part key, so lineitem joins flight on the part key
    fl = fb.groupBy("p_partkey").agg(F.min("Airplane_ID").alias("Airplane_ID")).withColumn("Flight_ID", flight_code_of(F.col("p_partkey")))

    def links_of(some: DataFrame | None = None) -> DataFrame:
        """The ticket links, of the orders ``some`` (ID) if given. Other orders' links drop out first, and repeats go where the rows are narrow and
        their key has the seat and the order, so a flight with a third of the links is spread over all tasks."""
        li = lineitem.select("l_orderkey", "l_partkey", F.col("l_linenumber").alias("SEAT_Row_num"),
                             seat_letter(F.col("l_suppkey") % 6 + 1).alias("SEAT_Column_number"), (F.col("l_suppkey") % 6 < 4).alias("front"))
        if some is not None:
            li = li.join(some.select(F.col("ID").alias("l_orderkey")), "l_orderkey", "left_semi")
        return (li.distinct().join(fl.withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "inner")
                .select("Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number",
                        F.when((F.col("Airplane_ID") % 2 == 0) & (F.col("SEAT_Row_num") <= 2) & F.col("front"), "First")
                         .otherwise("Regular").alias("CLASS_Type"),
                        F.col("l_orderkey").alias("Order_ID")))

    ticket_order = links_of()

    flight_priced = flight.select(F.col("ID").alias("Flight_ID"), "Airplane_ID", "Status", "p_retailprice")
    ticket = build_ticket(flight_priced, seat, links_of(booking.where(F.col("Status") == "Active")))

    cc = F.col("c_custkey")
    aircrew = customer.select(
        cc.alias("ID"), F.lit("City").alias("City"), F.lit("Street").alias("Street"),
        F.lit("1").alias("House_Number"), F.to_date(F.lit("1990-01-01")).alias("Start_date_of_employment"),
        F.col("c_mktsegment").alias("First_name"), F.col("c_name").alias("Last_name"),
        F.lit("050").alias("Phone_number"),
        F.when(cc % 3 == 0, "Pilot").otherwise("Flight attendant").alias("Type"),
        (F.col("c_nationkey") % 2).alias("Training"),
    )

    aircrew_assignment = (orders.select("o_orderkey", "o_custkey")
                          .join(lineitem.where(F.col("l_linenumber") == 1)
                                .select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey"),
                                "o_orderkey", "inner")
                          .select(F.col("o_custkey").alias("Aircrew_ID"),
                                  flight_code_of(F.col("l_partkey")).alias("Flight_ID"))
                          .distinct())

    member = customer.where(cc % 3 != 0).select(
        F.concat(F.lit("m"), cc.cast("string"), F.lit("@example.com")).alias("Email"),
        F.col("c_mktsegment").alias("First_name_in_English"),
        F.col("c_name").alias("Last_name_in_English"),
        F.concat(F.lit("P"), cc.cast("string")).alias("Passport_number"),
        F.to_date(F.lit("1980-01-01")).alias("Date_of_birth"),
        F.to_date(F.lit("1999-01-01")).alias("Register_date"),
    )
    guest = customer.where(cc % 3 == 0).select(
        F.concat(F.lit("g"), cc.cast("string"), F.lit("@example.com")).alias("Email"),
        F.col("c_mktsegment").alias("First_name_in_English"),
        F.col("c_name").alias("Last_name_in_English"),
    )
    # two phone numbers per member: prefixes '050' and '052'
    phone_number_member = member.select(
        "Email", F.explode(F.array(F.lit("050"), F.lit("052"))).alias("prefix"), "Passport_number"
    ).select("Email", F.concat("prefix", "Passport_number").alias("Phone_number"))
    phone_number_guest = guest.select("Email", F.concat(F.lit("054"), F.col("Email")).alias("Phone_number"))

    region = _read(spark, sf_dir, "region")
    airport = (nation.join(region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), "n_regionkey", "left")
               .select(F.col("n_name").alias("Code"),
                       F.concat_ws(" — ", F.col("n_name"), F.col("r_name")).alias("Label")))

    out = Airline(airport=airport, airplane=airplane, klass=klass, seat=seat, flight_route=flight_route,
                   flight=flight.drop("p_retailprice"), booking=booking, ticket_order=ticket_order,
                   ticket=ticket, aircrew=aircrew, aircrew_assignment=aircrew_assignment,
                   member=member, guest=guest, phone_number_member=phone_number_member,
                   phone_number_guest=phone_number_guest)
    out.sf_dir = sf_dir
    out.flight_priced = flight_priced
    out.links_of = links_of
    return out


def order_links(t: Airline, orders: DataFrame) -> DataFrame:
    """``t.ticket_order`` of the orders ``orders`` (ID). Derived tables keep only these from the start; others are joined."""
    made = getattr(t, "links_of", None)
    return made(orders) if made else t.ticket_order.join(orders.select(F.col("ID").alias("Order_ID")), "Order_ID", "left_semi")


def seat_price(cls: str, list_price: str) -> Column:
    """First costs 3x the list price."""
    return F.when(F.col(cls) == "First", F.col(list_price) * 3).otherwise(F.col(list_price))


def links_with_price(t: Airline, links: DataFrame, flights: DataFrame) -> DataFrame:
    """``links`` joined to their tickets, adding ``Price``, and to ``flights`` (Flight_ID and more). Where tickets are derived, the seats of a flight's
    aircraft travel as one array with the flight and links meet them there, so that no ticket which nobody asks for is formed or shuffled."""
    priced, seat = getattr(t, "flight_priced", None), ["SEAT_Row_num", "SEAT_Column_number", "CLASS_Type"]
    if priced is None:
        return links.join(t.ticket.select("Airplane_ID", "Flight_ID", *seat, "Price"), ["Airplane_ID", "Flight_ID", *seat]).join(flights, "Flight_ID")
    seats = t.seat.groupBy("Airplane_ID").agg(F.collect_list(F.struct(F.col("Row_num").alias("row"), F.col("Column_number").alias("letter"),
                                                                      F.col("Class_Type").alias("class"))).alias("seats"))
    sold = priced.select("Flight_ID", "Airplane_ID", "p_retailprice").join(seats, "Airplane_ID").join(flights, "Flight_ID")
    at = links.join(sold, ["Flight_ID", "Airplane_ID"]).withColumn("s", F.explode("seats"))
    return (at.where((F.col("s.row") == F.col("SEAT_Row_num")) & (F.col("s.letter") == F.col("SEAT_Column_number")) & (F.col("s.class") == F.col("CLASS_Type")))
            .withColumn("Price", seat_price("CLASS_Type", "p_retailprice")).drop("s", "seats", "p_retailprice"))


def build_ticket(flight_priced: DataFrame, seat: DataFrame, active: DataFrame) -> DataFrame:
    """One ticket per (flight, seat of its aircraft); First costs 3x the list price; a seat is
    unavailable when the flight is cancelled or an Active order holds it (``active``: the links of these).

    The seats held on a flight travel as one array with the flight (no more than it has seats), and its tickets are
    formed last, so they are never shuffled here."""
    def place(row: Column) -> Column:
        return F.struct(row.cast("long").alias("row"), F.col("SEAT_Column_number").alias("letter"), F.col("CLASS_Type").alias("class"))

    held = (active.where("SEAT_Row_num IS NOT NULL AND SEAT_Column_number IS NOT NULL AND CLASS_Type IS NOT NULL")
            .groupBy("Flight_ID").agg(F.collect_set(place(F.col("SEAT_Row_num"))).alias("held")))
    taken = F.coalesce(F.array_contains("held", place(F.col("SEAT_Row_num"))), F.lit(False))
    return (flight_priced.join(held, "Flight_ID", "left")
            .join(seat.select("Airplane_ID", F.col("Row_num").alias("SEAT_Row_num"),
                              F.col("Column_number").alias("SEAT_Column_number"),
                              F.col("Class_Type").alias("CLASS_Type")), "Airplane_ID", "inner")
            .select("Airplane_ID", "Flight_ID", "SEAT_Row_num", "SEAT_Column_number", "CLASS_Type",
                    seat_price("CLASS_Type", "p_retailprice").alias("Price"),
                    F.when((F.col("Status") == "Canceled") | taken, 0)
                     .otherwise(1).alias("Availability")))


def materialize(t: Airline, path: str, mode: str = "overwrite") -> None:
    """Write every table as parquet under ``path`` (one directory per table).

    ``ticket`` is hash-partitioned on ``Flight_ID`` and sorted inside each file, so row-group min/max statistics prune flight
    predicates without a sampling pass; ``ticket_order`` is sorted inside each file only (its keys are dealt by seat and order);
    ``flight`` is range-partitioned on ``dep_ts`` (the "not departed" predicates). ``ticket``
    is built from the stored ``ticket_order`` rather than re-deriving it.
    """
    def w(name: str, df: DataFrame) -> None:
        df.write.mode(mode).parquet(os.path.join(path, name))

    tabs = t.tables()
    jobs = [(n, tabs[n]) for n in ("airport", "airplane", "class", "seat", "flight_route", "booking", "aircrew",
                                   "aircrew_assignment", "member", "guest", "phone_number_member",
                                   "phone_number_guest")]
    jobs.append(("flight", tabs["flight"].repartitionByRange("dep_ts").sortWithinPartitions("dep_ts")))
    jobs.append(("ticket_order", tabs["ticket_order"].sortWithinPartitions("Flight_ID")))
    # independent tables are written as concurrent Spark jobs (the cluster schedules their tasks)
    with ThreadPoolExecutor(max_workers=4) as pool:
        list(pool.map(lambda nd: w(*nd), jobs))
    spark = t.airplane.sparkSession
    stored = {n: spark.read.parquet(os.path.join(path, n)) for n in ("seat", "booking", "ticket_order")}
    priced = getattr(t, "flight_priced", None)
    live = stored["booking"].where(F.col("Status") == "Active").select(F.col("ID").alias("Order_ID"))
    ticket = (build_ticket(priced, stored["seat"], stored["ticket_order"].join(live, "Order_ID", "left_semi"))
              if priced is not None else tabs["ticket"])
    w("ticket", ticket.repartition("Flight_ID").sortWithinPartitions("Flight_ID"))

def load(spark: SparkSession, path: str) -> Airline:
    """Read tables written by :func:`materialize`."""
    rd = {n: spark.read.parquet(os.path.join(path, n)) for n in
          ("airplane", "class", "seat", "flight_route", "flight", "booking", "ticket_order", "ticket",
           "aircrew", "aircrew_assignment", "member", "guest", "phone_number_member", "phone_number_guest",
           "airport")}
    rd["klass"] = rd.pop("class")
    return Airline(**rd)
