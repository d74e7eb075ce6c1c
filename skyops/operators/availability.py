"""Resource availability at an airport and a time (D-02 … D-08), set-at-a-time.

A *request* is a row ``(rid, airport, ts[, flight_type])``; every operator answers any
number of requests in one plan.

Location is modelled as intervals:

* an aircraft is at the arrival airport of a non-cancelled leg from that leg's arrival until
  its next (strictly later) arrival — so "the latest arrival at or before t (ties kept) is at
  the airport" becomes "t falls in one of the aircraft's intervals at the airport";
* a crew member is at the arrival airport of a candidate leg (its latest Completed leg over
  all time, or any Active/Full leg) from that arrival until its next Active/Full departure.

*Free time* (:func:`free_time`) is what is left of these stays after the resource's own flights are taken out, as half-open intervals that are
disjoint per resource and airport. A departure at exactly ``t`` blocks the interval ``[t, t + 1 µs)``; timestamps are whole microseconds. Every
question about a request is then one about the free intervals that hold its instant:

* counts (D-06) are running sums over the airport's changes, six classes of resources at once, read off at the requests' instants;
* the earliest feasible slot (D-07) comes from the same running sums as feasible periods, met by forward as-of lookups;
* recommendations (D-08) merge the first few members that the nodes of a tree over the airport's request instants keep.

None of them forms (request, resource) pairs. The pairs themselves (D-02, D-03) are unpacked from arrays by
:func:`~skyops.operators.intervals.interval_point_pairs`, an equi join on airport + dyadic time block.

Resources that never flew (aircraft) or were never assigned (crew) are available at every
request. They are kept as a separate *floating* set instead of being paired with every
request (that pairing is a cross product); counts and recommendations add them through
bounded scalar aggregates or a bounded per-request top-N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyops.operators import intervals as I
from skyops.operators import relational as Rel
from skyops.session import cut_lineage
from skyops.sources.airline import Airline

# Crew requirement per aircraft size and the Long ⇒ Big rule
REQUIREMENT = {"Big": (3, 6), "Small": (2, 3)}   # (pilots, attendants)
LONG_NEEDS_SIZE = "Big"
CANDIDATES_PER_KIND = 20                         # next arrivals / next departures examined
NON_CANCELLED = ("Active", "Full", "Completed")
OPEN = ("Active", "Full")
FAR_FUTURE = "9999-12-31 00:00:00"


# ---- aircraft ------------------------------------------------------------------------------

def aircraft_locations(flight: DataFrame) -> DataFrame:
    """(Airplane_ID, airport, from_ts, to_ts): where each aircraft is between arrivals."""
    legs = flight.where(F.col("Status").isin(*NON_CANCELLED)).select("Airplane_ID", "Arrival_airport", "arr_ts")
    nxt = I.next_event_after(legs, legs.select("Airplane_ID", F.col("arr_ts").alias("_e")), ["Airplane_ID"],
                             "arr_ts", "_e", "to_ts")
    return nxt.select("Airplane_ID", F.col("Arrival_airport").alias("airport"), F.col("arr_ts").alias("from_ts"),
                      "to_ts").distinct()


def in_flight_at(flight: DataFrame, requests: DataFrame) -> DataFrame:
    """J-10: the requests ``(…, Airplane_ID, ts)`` whose own aircraft is mid-flight: one of its Active/Full
    legs has ``dep_ts <= ts < arr_ts``."""
    legs = flight.where(F.col("Status").isin(*OPEN)).select(
        "Airplane_ID", F.col("dep_ts").alias("_f"), F.col("arr_ts").alias("_to"))
    return I.interval_point_join(requests, legs, ["Airplane_ID"], "ts", "_f", "_to", how="left_semi")


def last_arrival_at(flight: DataFrame, requests: DataFrame) -> DataFrame:
    """J-11: for requests ``(rid, Airplane_ID, ts)`` the aircraft's latest non-cancelled leg
    arriving at or before ``ts`` (all legs tied on that instant are returned)."""
    legs = flight.where(F.col("Status").isin(*NON_CANCELLED)).select(
        "Airplane_ID", F.col("ID").alias("Flight_ID"), "arr_ts", "Arrival_airport")
    nxt = I.next_event_after(legs, legs.select("Airplane_ID", F.col("arr_ts").alias("_e")), ["Airplane_ID"],
                             "arr_ts", "_e", "_to")
    return I.interval_point_join(requests, nxt, ["Airplane_ID"], "ts", "arr_ts", "_to").drop("_to")


def floating_aircraft(t: Airline) -> DataFrame:
    """Aircraft with no Active/Full/Completed leg: available at any airport."""
    flown = t.flight.where(F.col("Status").isin(*NON_CANCELLED)).select(F.col("Airplane_ID").alias("ID"))
    return Rel.anti(t.airplane, flown, "ID").select(F.col("ID").alias("Airplane_ID"), "Size", "Manufacturer")


def aircraft_available(t: Airline, requests: DataFrame) -> DataFrame:
    """D-02 (located part): ``(rid, ts, Airplane_ID, Size, Manufacturer)`` for aircraft whose
    latest arrival at or before ``ts`` is at the request airport, of the requested size
    (``need_size`` NULL = any), with no leg departing exactly at ``ts`` and not mid-flight.
    Floating aircraft: :func:`floating_aircraft`.

    Flights are taken out of the stays first (:func:`aircraft_free`), so the pairs are formed by one join, the last step, and are never shuffled. Free
    intervals are disjoint per aircraft and airport: each (request, aircraft) pair meets at most once."""
    req = requests.select("rid", "airport", "ts",
                          (F.col("need_size") if "need_size" in requests.columns else F.lit(None).cast("string"))
                          .alias("need_size"))
    planes = t.airplane.select(F.col("ID").alias("Airplane_ID"), "Size", "Manufacturer")
    free = cut_lineage(aircraft_free(t).join(planes, "Airplane_ID"))
    at = I.interval_point_pairs(req, free, ["airport"], "ts", "from_ts", "to_ts")
    return at.where(F.col("need_size").isNull() | (F.col("Size") == F.col("need_size"))).select("rid", "ts", "Airplane_ID", "Size", "Manufacturer")


# ---- crew ----------------------------------------------------------------------------------

def crew_legs(t: Airline) -> DataFrame:
    return t.aircrew_assignment.join(
        t.flight.select(F.col("ID").alias("Flight_ID"), "dep_ts", "arr_ts", "Status", "Arrival_airport"),
        "Flight_ID", "inner")


def crew_intervals(t: Airline) -> DataFrame:
    """D-04: ``(Aircrew_ID, airport, from_ts, to_ts, branch)`` — a crew member is at ``airport``
    from a candidate arrival until the next Active/Full departure (``to_ts`` NULL = none).

    Candidate arrivals: the member's latest Completed leg over all time (ties kept,
    ``branch='completed'``) and every Active/Full leg (``branch='arriving'``).
    """
    legs = crew_legs(t)
    done = legs.where(F.col("Status") == "Completed").select("Aircrew_ID", "Arrival_airport", "arr_ts")
    latest = Rel.latest_rows(done, ["Aircrew_ID"], "arr_ts").withColumn("branch", F.lit("completed"))
    arriving = (legs.where(F.col("Status").isin(*OPEN)).select("Aircrew_ID", "Arrival_airport", "arr_ts")
                .withColumn("branch", F.lit("arriving")))
    arrivals = latest.unionByName(arriving)
    deps = legs.where(F.col("Status").isin(*OPEN)).select("Aircrew_ID", F.col("dep_ts").alias("_d"))
    iv = I.next_event_after(arrivals, deps, ["Aircrew_ID"], "arr_ts", "_d", "to_ts")
    return iv.select("Aircrew_ID", F.col("Arrival_airport").alias("airport"), F.col("arr_ts").alias("from_ts"),
                     "to_ts", "branch").distinct()


def floating_crew(t: Airline) -> DataFrame:
    """Crew never assigned to any flight (any status): available everywhere."""
    return Rel.anti(t.aircrew, t.aircrew_assignment.select(F.col("Aircrew_ID").alias("ID")), "ID") \
              .select(F.col("ID").alias("Aircrew_ID"), "Type", "Training")


def crew_available(t: Airline, requests: DataFrame) -> DataFrame:
    """D-03 (located part): ``(rid, ts, Aircrew_ID, Type, Training)`` for crew at the request
    airport at ``ts`` and not assigned to any flight departing exactly at ``ts``.
    Floating crew: :func:`floating_crew`. As in :func:`aircraft_available`, the pairs are formed last, out of :func:`crew_free`."""
    crew = t.aircrew.select(F.col("ID").alias("Aircrew_ID"), "Type", "Training")
    free = cut_lineage(crew_free(t).join(crew, "Aircrew_ID"))
    at = I.interval_point_pairs(requests.select("rid", "airport", "ts"), free, ["airport"], "ts", "from_ts", "to_ts")
    return at.select("rid", "ts", "Aircrew_ID", "Type", "Training")


# ---- requirements, feasibility, suggestions ------------------------------------------------

def crew_requirement(df: DataFrame, by: str = "type", col: str | None = None) -> DataFrame:
    """D-05: add ``need_size``, ``need_training``, ``req_pilots``, ``req_attendants``.

    ``by='type'``: Long → Big aircraft, trained crew, 3 + 6; Short → any size, 2 + 3.
    ``by='size'``: Big → 3 + 6, Small → 2 + 3 (crew training still follows the flight type
    when a ``flight_type`` column is present).
    """
    if by == "type":
        ft = F.col(col or "flight_type")
        is_long = ft == "Long"
        big, small = REQUIREMENT["Big"], REQUIREMENT["Small"]
        return (df.withColumn("need_size", F.when(is_long, F.lit(LONG_NEEDS_SIZE)))
                  .withColumn("need_training", is_long)
                  .withColumn("req_pilots", F.when(is_long, big[0]).otherwise(small[0]))
                  .withColumn("req_attendants", F.when(is_long, big[1]).otherwise(small[1])))
    size = F.col(col or "Size")
    out = (df.withColumn("req_pilots", F.when(size == "Big", REQUIREMENT["Big"][0]).otherwise(REQUIREMENT["Small"][0]))
             .withColumn("req_attendants", F.when(size == "Big", REQUIREMENT["Big"][1]).otherwise(REQUIREMENT["Small"][1])))
    if "flight_type" in df.columns and "need_training" not in df.columns:
        out = out.withColumn("need_training", F.col("flight_type") == "Long")
    return out


def merged_crew_intervals(iv: DataFrame) -> DataFrame:
    """Crew intervals made disjoint per (crew, airport): two intervals of one member at one airport
    either end at the same next departure (one contains the other) or do not overlap, so the
    earliest start per (crew, airport, end) is kept."""
    return iv.groupBy("Aircrew_ID", "airport", "to_ts").agg(F.min("from_ts").alias("from_ts"))


# ---- free time -----------------------------------------------------------------------------

# classes of resources that are counted apart: what a Long flight needs, and the rest of its kind
PLANE_CLASSES = ("big", "other")
CREW_CLASSES = ("pilot1", "pilot0", "attendant1", "attendant0")   # 1: trained
CLASSES = PLANE_CLASSES + CREW_CLASSES


def plane_class(size: Column) -> Column:
    return F.when(size == LONG_NEEDS_SIZE, "big").otherwise("other")


def crew_class(kind: Column, training: Column) -> Column:
    """NULL for other kinds of crew: they are never needed."""
    return F.concat(F.when(kind == "Pilot", "pilot").when(kind == "Flight attendant", "attendant"), F.when(training == 1, "1").otherwise("0"))


def _just_after(ts) -> Column:
    return F.timestamp_add("MICROSECOND", F.lit(1), F.col(ts) if isinstance(ts, str) else ts)


def aircraft_free(t: Airline) -> DataFrame:
    """(Airplane_ID, airport, from_ts, to_ts): stays without the aircraft's open flights and the instants at which any of its legs departs.

    One scan per aircraft: the airports of the latest arrival so far, and how many flights or departures are going on."""
    f = t.flight
    arrived = f.where(F.col("Status").isin(*NON_CANCELLED)).select("Airplane_ID", F.col("arr_ts").alias("ts"), F.col("Arrival_airport").alias("place"), F.lit(0).alias("d"))
    nowhere = F.lit(None).cast("string").alias("place")
    flying = f.where(F.col("Status").isin(*OPEN) & (F.col("arr_ts") > F.col("dep_ts")))
    leaving = f.select("Airplane_ID", "dep_ts", _just_after("dep_ts").alias("arr_ts"))
    events = arrived
    for busy in (flying, leaving):
        events = (events.unionByName(busy.select("Airplane_ID", F.col("dep_ts").alias("ts"), nowhere, F.lit(1).alias("d")))
                  .unionByName(busy.select("Airplane_ID", F.col("arr_ts").alias("ts"), nowhere, F.lit(-1).alias("d"))))
    events = events.groupBy("Airplane_ID", "ts").agg(F.sum("d").alias("busy"), F.collect_set("place").alias("places"))
    events = events.withColumn("places", F.when(F.size("places") > 0, F.col("places")))  # one leg, or legs tied on the instant
    s = I.carry_scan(events, ["Airplane_ID"], "ts", sums=["busy"], lasts=["places"], lead="to_ts")
    return s.where("busy = 0").select("Airplane_ID", F.explode("places").alias("airport"), F.col("ts").alias("from_ts"), "to_ts")


def crew_free(t: Airline) -> DataFrame:
    """(Aircrew_ID, airport, from_ts, to_ts): stays without the instants at which any leg of the member departs.

    The stays are those of :func:`merged_crew_intervals`. Open departures cut a member's time into epochs, numbered by one scan: candidate arrivals of an
    epoch are stays until its end, and a departure meets the stays of its own epoch (equi join on member and epoch)."""
    legs = crew_legs(t)
    opened, done = F.col("Status").isin(*OPEN), F.col("Status") == "Completed"
    latest = legs.where(done).groupBy("Aircrew_ID").agg(F.max("arr_ts").alias("latest"))
    candidate = opened | (done & (F.col("arr_ts") == F.col("latest")))
    ends = F.array(F.struct(F.col("dep_ts").alias("ts"), opened.cast("int").alias("cut"), F.lit(1).alias("leaves"), F.lit(None).cast("string").alias("place")),
                   F.struct(F.col("arr_ts").alias("ts"), F.lit(0).alias("cut"), F.lit(0).alias("leaves"), F.when(candidate, F.col("Arrival_airport")).alias("place")))
    events = (legs.join(latest, "Aircrew_ID", "left").select("Aircrew_ID", F.explode(ends).alias("e")).select("Aircrew_ID", "e.*")
              .where("leaves = 1 OR place IS NOT NULL")
              .groupBy("Aircrew_ID", "ts").agg(F.max("cut").alias("cut"), F.max("leaves").alias("leaves"), F.collect_set("place").alias("places")))
    at = cut_lineage(I.carry_scan(events.withColumn("epoch", F.col("cut")), ["Aircrew_ID"], "ts", sums=["epoch"]))
    until = at.where("cut = 1").select("Aircrew_ID", (F.col("epoch") - 1).alias("epoch"), F.col("ts").alias("to_ts"))
    stays = (at.where("size(places) > 0").select("Aircrew_ID", "epoch", "ts", F.explode("places").alias("airport"))
             .groupBy("Aircrew_ID", "epoch", "airport").agg(F.min("ts").alias("from_ts")).join(until, ["Aircrew_ID", "epoch"], "left"))
    inside = at.where("leaves = 1").select("Aircrew_ID", "epoch", "ts").join(stays.drop("to_ts"), ["Aircrew_ID", "epoch"]).where("from_ts <= ts")

    def change(df: DataFrame, *steps: tuple[Column, int]) -> DataFrame:
        both = F.explode(F.array(*[F.struct(ts.alias("ts"), F.lit(d).alias("here")) for ts, d in steps])).alias("e")
        return df.select("Aircrew_ID", "airport", both).select("Aircrew_ID", "airport", "e.*").where("ts IS NOT NULL")

    changes = (change(stays, (F.col("from_ts"), 1), (F.col("to_ts"), -1)).unionByName(change(inside, (F.col("ts"), -1), (_just_after("ts"), 1)))
               .groupBy("Aircrew_ID", "airport", "ts").agg(F.sum("here").alias("here")))
    s = I.carry_scan(changes, ["Aircrew_ID", "airport"], "ts", sums=["here"], lead="to_ts")
    return s.where("here > 0").select("Aircrew_ID", "airport", F.col("ts").alias("from_ts"), "to_ts")


def free_time(t: Airline) -> tuple[DataFrame, DataFrame]:
    """The free intervals of aircraft (with Size, Manufacturer) and of crew (Type, Training), each with its class ``cls``; written once."""
    planes = aircraft_free(t).join(t.airplane.select(F.col("ID").alias("Airplane_ID"), "Size", "Manufacturer"), "Airplane_ID") \
        .withColumn("cls", plane_class(F.col("Size")))
    crew = crew_free(t).join(t.aircrew.select(F.col("ID").alias("Aircrew_ID"), "Type", "Training"), "Aircrew_ID") \
        .withColumn("cls", crew_class(F.col("Type"), F.col("Training")))
    return cut_lineage(planes), cut_lineage(crew)


def located_counts(free: tuple[DataFrame, DataFrame], marks: DataFrame, lead: str | None = None) -> DataFrame:
    """(airport, ts, mark, one count per class of :data:`CLASSES`) at every instant where free time changes or ``marks`` (airport, ts) has a row
    (``mark`` 1), and with ``lead`` until when. One scan per airport over changes already summed per instant."""
    changes = None
    for f in free:
        for ts, d in (("from_ts", 1), ("to_ts", -1)):
            part = f.select("airport", F.col(ts).alias("ts"), "cls", F.lit(d).alias("d")).where("ts IS NOT NULL")
            changes = part if changes is None else changes.unionByName(part)
    each = [F.sum(F.when(F.col("cls") == c, F.col("d")).otherwise(0)).alias(c) for c in CLASSES]
    at = changes.groupBy("airport", "ts").agg(*each)
    none = [F.lit(0).cast("long").alias(c) for c in CLASSES]
    at = at.select("airport", "ts", *CLASSES, F.lit(0).alias("mark")).unionByName(marks.select("airport", "ts", *none, F.lit(1).alias("mark")))
    at = at.groupBy("airport", "ts").agg(*[F.sum(c).alias(c) for c in CLASSES], F.max("mark").alias("mark"))
    return I.carry_scan(at, ["airport"], "ts", sums=CLASSES, lead=lead)


def floating_counts(t: Airline) -> Column:
    """How many floating resources there are of each class, as one struct."""
    planes = floating_aircraft(t).select(plane_class(F.col("Size")).alias("cls"))
    crew = floating_crew(t).select(crew_class(F.col("Type"), F.col("Training")).alias("cls"))
    n = planes.unionByName(crew).agg(*[F.count_if(F.col("cls") == c).alias(c) for c in CLASSES])
    return n.select(F.struct(*CLASSES).alias("n")).scalar()


def floating_blocked(t: Airline) -> DataFrame:
    """(ts, big, other): floating aircraft that can't start at ``ts``, where one of their (cancelled) legs departs."""
    legs = floating_aircraft(t).join(t.flight.select("Airplane_ID", F.col("dep_ts").alias("ts")), "Airplane_ID").select("Airplane_ID", "Size", "ts").distinct()
    return legs.groupBy("ts").agg(*[F.count_if(plane_class(F.col("Size")) == c).alias(f"blocked_{c}") for c in PLANE_CLASSES])


def _needed(counts: str, is_long: Column) -> dict[str, Column]:
    """Aircraft, pilots and attendants that suit a flight, out of columns ``<counts><class>``."""
    c = {k: F.col(f"{counts}{k}") for k in CLASSES}

    def of(kind: str, wanted: str, rest: str) -> Column:
        return (c[wanted] + F.when(is_long, 0).otherwise(c[rest])).alias(kind)

    return {"aircraft": of("aircraft", "big", "other"), "pilots": of("pilots", "pilot1", "pilot0"), "attendants": of("attendants", "attendant1", "attendant0")}


def availability_counts(t: Airline, requests: DataFrame, free: tuple[DataFrame, DataFrame]) -> DataFrame:
    """``requests`` (rid, ts, airport, need_training and more) with available aircraft, pilots and attendants that suit them, located and floating."""
    located = located_counts(free, requests.select("airport", "ts").distinct()).where("mark = 1").drop("mark")
    n = requests.join(located, ["airport", "ts"]).join(floating_blocked(t), "ts", "left").withColumn("float", floating_counts(t))
    taken = {c: F.coalesce(f"blocked_{c}", F.lit(0)) for c in PLANE_CLASSES}
    n = n.withColumns({c: F.col(c) + F.col(f"float.{c}") - taken.get(c, F.lit(0)) for c in CLASSES})
    return n.select(*requests.columns, *[c.cast("long").alias(k) for k, c in _needed("", F.col("need_training")).items()])


def feasibility(t: Airline, requests: DataFrame, free: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """D-06: per request — available aircraft / pilots / attendants, what is short, feasible."""
    req = crew_requirement(requests, "type")
    n = availability_counts(t, req.select("rid", "airport", "ts", "need_training", "req_pilots", "req_attendants"), free or free_time(t))
    short = F.concat_ws(",", F.when(F.col("aircraft") <= 0, F.lit("aircraft")),
                        F.when(F.col("pilots") < F.col("req_pilots"), F.lit("pilots")),
                        F.when(F.col("attendants") < F.col("req_attendants"), F.lit("attendants")))
    return n.select("rid", "ts", "aircraft", "pilots", "attendants",
                    F.col("req_pilots").cast("long").alias("req_pilots"),
                    F.col("req_attendants").cast("long").alias("req_attendants"),
                    F.when(short != "", short).alias("short_of"),
                    (short == "").alias("feasible"))


def future_arrivals(flight: DataFrame, requests: DataFrame, k: int = CANDIDATES_PER_KIND) -> DataFrame:
    """O-03: the next ``k`` distinct Active/Full arrival instants at the request airport
    strictly after ``ts`` → ``(rid, airport, ts, cand_ts)``."""
    arr = flight.where(F.col("Status").isin(*OPEN)).select(F.col("Arrival_airport").alias("airport"), "arr_ts")
    return I.next_k_distinct(requests.select("rid", "airport", "ts"), arr, ["airport"], "ts", "arr_ts", k, "cand_ts")


def future_departures(flight: DataFrame, requests: DataFrame, k: int = CANDIDATES_PER_KIND) -> DataFrame:
    """The next ``k`` distinct departure instants (any airport, any status) after ``ts``."""
    return I.next_k_distinct(requests.select("rid", "airport", "ts"), flight.select("dep_ts"), [], "ts",
                             "dep_ts", k, "cand_ts")


def _first_departures(t: Airline, pieces: DataFrame, blocked: DataFrame, float_n: Column) -> DataFrame:
    """(airport, flight_type, ts): the first departure instant (anywhere) of each of ``pieces`` (airport, flight_type, ts, to_ts, planes) that has one.

    The pieces have enough crew, and ``planes`` says whether a located aircraft suits. At departure instants where a floating aircraft suits crew is all it
    takes; at the others ``planes`` has to hold."""
    deps = t.flight.select(F.col("dep_ts").alias("ts")).distinct().join(blocked, "ts", "left").withColumn("float", float_n)
    left = {c: F.col(f"float.{c}") - F.coalesce(f"blocked_{c}", F.lit(0)) for c in PLANE_CLASSES}
    floats = {"Long": left["big"] > 0, "Short": left["big"] + left["other"] > 0}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("flight_type"), v.alias("floats")) for k, v in floats.items()]))
    deps = deps.select(F.col("ts").alias("_d"), kinds.alias("x")).select("_d", "x.*")
    starts = pieces.withColumn("floats", F.explode(F.when(F.col("planes"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))))
    starts = starts.select("airport", "flight_type", "floats", "to_ts", F.timestamp_add("MICROSECOND", F.lit(-1), F.col("ts")).alias("_before"))
    first = I.next_event_after(starts, deps, ["flight_type", "floats"], "_before", "_d", "ts")
    return first.where("ts < to_ts OR (to_ts IS NULL AND ts IS NOT NULL)").select("airport", "flight_type", "ts").distinct()


def earliest_slot(t: Airline, requests: DataFrame) -> DataFrame:
    """D-07: for infeasible requests, the earliest candidate time that is feasible.

    Candidates: the next 20 distinct Active/Full arrivals at the origin after ``ts`` ∪ the
    next 20 distinct departures anywhere after ``ts``. Fallback: the first future arrival;
    otherwise NULL. → ``(rid, ts, suggested_ts)`` for the infeasible requests.

    Candidates are not listed. The running counts per airport are cut where free time changes, at every arrival and just after every
    request; each piece is feasible or not for a Long and a Short flight. The next feasible arrival and the first departure of the next feasible
    piece that has one are looked up by as-of, and their ranks among all arrivals or departures tell whether they are among the next 20.
    """
    free = free_time(t)
    fz = feasibility(t, requests, free)
    bad = cut_lineage(requests.select("rid", "airport", "ts", "flight_type")
                      .join(fz.where(~F.col("feasible")).select("rid", "ts"), ["rid", "ts"], "left_semi"))
    arrivals = t.flight.where(F.col("Status").isin(*OPEN)).select(F.col("Arrival_airport").alias("airport"), F.col("arr_ts").alias("ts")).distinct()
    # the first piece of an airport begins before any request
    since = bad.select("airport", I._base().alias("ts"))
    marks = arrivals.unionByName(bad.select("airport", _just_after("ts").alias("ts"))).unionByName(since).distinct()
    float_n, blocked = floating_counts(t), cut_lineage(floating_blocked(t))

    pieces = located_counts(free, marks, "to_ts").withColumn("float", float_n).withColumn("flight_type", F.explode(F.array(F.lit("Long"), F.lit("Short"))))
    pieces = crew_requirement(pieces, "type")
    here, floats = _needed("", F.col("need_training")), _needed("float.", F.col("need_training"))
    enough = (here["pilots"] + floats["pilots"] >= F.col("req_pilots")) & (here["attendants"] + floats["attendants"] >= F.col("req_attendants"))
    pieces = cut_lineage(pieces.where(enough).select("airport", "flight_type", "ts", "to_ts", (here["aircraft"] > 0).alias("planes"), floats["aircraft"].alias("floats")))

    key = ["airport", "flight_type"]
    by_dep = _first_departures(t, pieces, blocked, float_n)
    gone = F.coalesce("blocked_big", F.lit(0)) + F.when(F.col("flight_type") == "Long", 0).otherwise(F.coalesce("blocked_other", F.lit(0)))
    by_arr = (pieces.join(arrivals, ["airport", "ts"], "left_semi").join(blocked, "ts", "left")
              .where(F.col("planes") | (F.col("floats") > gone)).select(*key, "ts"))
    asked = bad.select(*key, "ts").distinct()
    for events, keys, out in ((by_dep, key, "dep"), (by_arr, key, "arr"), (arrivals, ["airport"], "first_arr")):
        asked = I.next_event_after(asked, events.select(*keys, F.col("ts").alias("_e")), keys, "ts", "_e", out)
    asked = cut_lineage(asked)
    n_dep = I.events_between(asked, t.flight.select("dep_ts"), [], "ts", "dep", "dep_ts", "n_dep")
    n_arr = I.events_between(asked, arrivals.select("airport", F.col("ts").alias("_e")), ["airport"], "ts", "arr", "_e", "n_arr")
    near = asked.join(n_dep, ["ts", "dep"], "left").join(n_arr, ["airport", "ts", "arr"], "left")
    first = F.least(*[F.when(F.col(f"n_{c}") <= CANDIDATES_PER_KIND, F.col(c)) for c in ("dep", "arr")])  # NULLs are passed over
    return bad.join(near.select(*key, "ts", F.coalesce(first, "first_arr").alias("suggested_ts")), [*key, "ts"]).select("rid", "ts", "suggested_ts")


# ---- recommendations -----------------------------------------------------------------------

def instant_ranks(points: DataFrame, free: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(airport, ts, before, is_point, total): for each point and each end of a free interval, how many distinct points of the airport come before it."""
    ends = [f.select("airport", F.col(c).alias("ts"), F.lit(0).cast("long").alias("is_point")) for f in free for c in ("from_ts", "to_ts")]
    at = points.select("airport", "ts", F.lit(1).cast("long").alias("is_point"))
    for e in ends:
        at = at.unionByName(e.where("ts IS NOT NULL"))
    at = at.groupBy("airport", "ts").agg(F.max("is_point").alias("is_point")).withColumn("upto", F.col("is_point"))
    totals = points.groupBy("airport").agg(F.count(F.lit(1)).alias("total"))  # a row per airport
    return (I.carry_scan(at, ["airport"], "ts", sums=["upto"]).join(totals, "airport")
            .select("airport", "ts", (F.col("upto") - F.col("is_point")).alias("before"), "is_point", "total"))


def tree_entries(free: DataFrame, ranks: DataFrame) -> DataFrame:
    """``free`` × the tree nodes (airport, _lvl, _k) that cover the points in the interval."""
    lo = ranks.select("airport", F.col("ts").alias("from_ts"), F.col("before").alias("_lo"), "total")
    hi = ranks.select("airport", F.col("ts").alias("to_ts"), F.col("before").alias("_hi"))
    ranges = free.join(lo, ["airport", "from_ts"]).join(hi, ["airport", "to_ts"], "left").withColumn("_hi", F.coalesce("_hi", "total"))
    return I.rank_cover(ranges, "_lo", "_hi").drop("_lo", "_hi", "total", "from_ts", "to_ts")


def first_members(points: DataFrame, free: tuple[DataFrame, DataFrame], n: int) -> tuple[DataFrame, DataFrame]:
    """For each distinct point (airport, ts) of ``points``: the best located aircraft per Size, ``(airport, ts, Size, best)``, and the first ``n`` located crew per
    Type by Training descending and id, ``(airport, ts, Type, Training, Aircrew_ID)``.

    Both come from trees over the ranks of each airport's points. An interval enters the at most two nodes a level that cover exactly the points in it; a
    node keeps its best aircraft or first ``n`` crew (limited before the shuffle), and a point merges the nodes above it."""
    ranks = cut_lineage(instant_ranks(points, free))
    node = ["airport", "_lvl", "_k"]
    above = I.enclosing_blocks(ranks.where("is_point = 1").select("airport", "ts", "before", "total"), "before", F.col("total")).select(*node, "ts")
    planes = tree_entries(free[0], ranks).groupBy(*node, "Size").agg(F.min(F.struct("Manufacturer", "Airplane_ID")).alias("best"))
    best = above.join(planes, node).groupBy("airport", "ts", "Size").agg(F.min("best").alias("best"))
    order = [F.desc("Training"), F.col("Aircrew_ID")]
    crew = tree_entries(free[1].where("cls IS NOT NULL"), ranks).select(*node, "Type", "Training", "Aircrew_ID")
    crew = crew.withColumn("_n", F.row_number().over(Window.partitionBy(*node, "Type").orderBy(*order))).where(F.col("_n") <= n).drop("_n")
    first = (above.join(crew, node).withColumn("_n", F.row_number().over(Window.partitionBy("airport", "ts", "Type").orderBy(*order)))
             .where(F.col("_n") <= n).select("airport", "ts", "Type", "Training", "Aircrew_ID"))
    return best, first


def best_floating(t: Airline, points: DataFrame) -> DataFrame:
    """(ts, Size, best): the first floating aircraft by Manufacturer and ID, of each size, that does not depart at the instant ``ts`` of ``points``.

    Only as many of each size are ranked as can be blocked at one instant, and one more."""
    fl = cut_lineage(floating_aircraft(t))
    times = points.select("ts").distinct()
    blocked = cut_lineage(fl.join(t.flight.select("Airplane_ID", F.col("dep_ts").alias("ts")), "Airplane_ID").select("Airplane_ID", "Size", "ts")
                          .distinct().join(times, "ts", "left_semi"))
    per_time = blocked.groupBy("ts", "Size").agg(F.count(F.lit(1)).cast("int").alias("_nb"))
    most = per_time.agg(F.max("_nb")).first()[0] or 0
    ranked = (fl.withColumn("_r", F.row_number().over(Window.partitionBy("Size").orderBy("Manufacturer", "Airplane_ID"))).where(F.col("_r") <= most + 1)
              .select("Size", "_r", "Airplane_ID", F.struct("Manufacturer", "Airplane_ID").alias("best")))
    others = (per_time.withColumn("_r", F.explode(F.expr("sequence(1, _nb + 1)"))).join(ranked, ["Size", "_r"])
              .join(blocked, ["ts", "Size", "Airplane_ID"], "left_anti").groupBy("ts", "Size").agg(F.min("best").alias("_other")))
    first = ranked.where("_r = 1").select("Size", "best")  # a row per size
    return (times.withColumn("Size", F.explode(F.array(*[F.lit(s) for s in sorted(REQUIREMENT)]))).join(first, "Size")
            .join(per_time, ["ts", "Size"], "left").join(others, ["ts", "Size"], "left")
            .select("ts", "Size", F.when(F.col("_nb").isNull(), F.col("best")).otherwise(F.col("_other")).alias("best")).where("best IS NOT NULL"))


def crew_recommend(t: Airline, requests: DataFrame) -> DataFrame:
    """D-08: per request the recommended aircraft and the first N pilots / attendants.

    Aircraft: available (located ∪ floating), size-matched, ordered by Size descending *as
    text* (Small before Big), Manufacturer, ID; the first one whose size requirement the
    available crew can meet. Crew: Long flights take trained crew by ID; Short flights take
    Training descending, then ID. → rows ``(rid, ts, role, member_id, pos)``.

    Located members come from :func:`first_members`: the first N by Training descending hold the first N trained ones too.
    """
    req = crew_requirement(requests, "type").select("rid", "airport", "ts", "need_size", "need_training")
    free = free_time(t)
    top_n = max(max(v) for v in REQUIREMENT.values())
    points = req.select("airport", "ts").distinct()
    planes_here, crew_here = first_members(points, free, top_n)
    counts = availability_counts(t, req.select("rid", "airport", "ts", "need_training"), free).select("rid", "ts", "pilots", "attendants")

    fits = F.col("need_size").isNull() | (F.col("Size") == F.col("need_size"))
    wanted = req.select("rid", "airport", "ts", "need_size")
    best = (wanted.join(planes_here, ["airport", "ts"]).where(fits).select("rid", "ts", "Size", "best")
            .unionByName(wanted.join(best_floating(t, points), "ts").where(fits).select("rid", "ts", "Size", "best")))
    best = crew_requirement(best.groupBy("rid", "ts", "Size").agg(F.min("best").alias("best")), "size").join(counts, ["rid", "ts"]) \
        .where((F.col("pilots") >= F.col("req_pilots")) & (F.col("attendants") >= F.col("req_attendants")))
    # at most one row per size and request
    plane = best.groupBy("rid", "ts").agg(F.min_by(F.struct("best.Airplane_ID", "req_pilots", "req_attendants"),
                                                   F.struct(F.when(F.col("Size") == "Small", 0).otherwise(1), "best")).alias("p")).select("rid", "ts", "p.*")

    need = req.select("rid", "airport", "ts", "need_training")
    suits = ~F.col("need_training") | (F.col("Training") == 1)
    floating = (floating_crew(t).withColumn("_o", F.row_number().over(Window.partitionBy("Type").orderBy(F.desc("Training"), "Aircrew_ID")))
                .where(F.col("_o") <= top_n).drop("_o"))  # at most top_n rows a kind of crew
    pool = (need.join(crew_here, ["airport", "ts"]).where(suits).select("rid", "ts", "Type", "Training", "Aircrew_ID")
            .unionByName(need.withColumn("Type", F.explode(F.array(F.lit("Pilot"), F.lit("Flight attendant")))).join(F.broadcast(floating), "Type").where(suits)
                         .select("rid", "ts", "Type", "Training", "Aircrew_ID")))
    # trained members come first in the list of a Short flight, and are the whole list of a Long one
    crew = pool.withColumn("pos", F.row_number().over(Window.partitionBy("rid", "ts", "Type").orderBy(F.desc("Training"), "Aircrew_ID"))).join(plane, ["rid", "ts"]) \
        .where(F.col("pos") <= F.when(F.col("Type") == "Pilot", F.col("req_pilots")).otherwise(F.col("req_attendants")))
    crew = crew.select("rid", "ts", F.when(F.col("Type") == "Pilot", "pilot").otherwise("attendant").alias("role"),
                       F.col("Aircrew_ID").alias("member_id"), F.col("pos").cast("long").alias("pos"))
    planes = plane.select("rid", "ts", F.lit("airplane").alias("role"), F.col("Airplane_ID").alias("member_id"),
                          F.lit(1).cast("long").alias("pos"))
    return planes.unionByName(crew)
