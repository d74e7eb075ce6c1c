"""Flight creation as one operator: checked requests become flights, crew assignments and tickets (D-17)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyops.functions import exprs as X
from skyops.operators.availability import REQUIREMENT
from skyops.operators.booking import dense_index, ticket_generate
from skyops.session import cut_lineage
from skyops.sources.airline import Airline


def create_flights(t: Airline, requests: DataFrame, crew: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``requests``: rid, dep_ts, Origin_airport, Arrival_airport, Airplane_ID, price_regular, price_first;
    ``crew``: rid, role (``pilot`` / ``attendant``), Aircrew_ID.

    Outcome reason, first failing wins: no such route, missing field (aircraft or Regular price), aircraft
    not found, Big needs a First price, Long needs a Big aircraft, wrong crew count (3 + 6 on a Big, 2 + 3 on a
    Small aircraft), crew not trained (a Long flight needs trained crew throughout; unknown crew is not checked), no seats;
    ``ok`` otherwise. Flights that pass get the next ids ``F#####`` in (dep_ts, rid) order.
    → (outcomes: rid, reason, ID; flights; assignments; tickets)
    """
    chosen = crew.select("rid", "role", "Aircrew_ID").join(t.aircrew.select(F.col("ID").alias("Aircrew_ID"), "Training"), "Aircrew_ID", "left") \
        .groupBy("rid").agg(F.count_if(F.col("role") == "pilot").alias("_p"), F.count_if(F.col("role") == "attendant").alias("_a"), F.min("Training").alias("_t"))
    seated = t.seat.select("Airplane_ID").distinct().withColumn("_seated", F.lit(True))
    planes = t.airplane.select(F.col("ID").alias("Airplane_ID"), "Size")
    r = (requests.join(t.flight_route, ["Origin_airport", "Arrival_airport"], "left").join(planes, "Airplane_ID", "left")
         .join(seated, "Airplane_ID", "left").join(chosen, "rid", "left").withColumn("Type", X.flight_type("Flight_duration")))
    big, small = REQUIREMENT["Big"], REQUIREMENT["Small"]
    is_big = F.col("Size") == "Big"
    reason = (F.when(F.col("Flight_duration").isNull(), "no such route")
               .when(F.col("Airplane_ID").isNull() | F.col("price_regular").isNull(), "missing field")
               .when(F.col("Size").isNull(), "aircraft not found")
               .when(is_big & F.col("price_first").isNull(), "Big needs a First price")
               .when((F.col("Type") == "Long") & ~is_big, "Long needs a Big aircraft")
               .when((F.coalesce("_p", F.lit(0)) != F.when(is_big, big[0]).otherwise(small[0]))
                     | (F.coalesce("_a", F.lit(0)) != F.when(is_big, big[1]).otherwise(small[1])), "wrong crew count")
               .when((F.col("Type") == "Long") & (F.col("_t") != 1), "crew not trained")
               .when(F.col("_seated").isNull(), "no seats")
               .otherwise("ok"))
    checked = cut_lineage(r.withColumn("reason", reason).drop("_p", "_a", "_t", "_seated", "Size"))
    base = t.flight.select(F.coalesce(F.max(X.flight_no("ID")), F.lit(0)).cast("long")).scalar()
    ok = dense_index(checked.where("reason = 'ok'"), [F.col("dep_ts"), F.col("rid")]).withColumn("ID", X.flight_code(base + F.col("idx")))
    outcomes = checked.select("rid", "reason").join(ok.select("rid", "ID"), "rid", "left")
    flights = ok.select("ID", "dep_ts", X.add_minutes("dep_ts", "Flight_duration").alias("arr_ts"), F.lit("Active").alias("Status"), "Type",
                        "Airplane_ID", "Origin_airport", "Arrival_airport")
    assignments = crew.join(ok.select("rid", "ID"), "rid").select("Aircrew_ID", F.col("ID").alias("Flight_ID"))
    tickets = ticket_generate(ok.select(F.col("ID").alias("Flight_ID"), "Airplane_ID", "price_regular", "price_first"), t.seat)
    return outcomes, flights, assignments, tickets
