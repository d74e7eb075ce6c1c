"""Registered availability queries (D-02 … D-08, J-10/J-11 helpers live in q_relational).

Requests are derived from the schedule: every Active/Full flight asks for resources at its
origin at its departure instant, so the request table grows with the flight table.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from skyops.operators import availability as A
from skyops.plans.catalog import query


def requests_of(t):
    return t.flight.where(F.col("Status").isin("Active", "Full")).select(
        F.col("ID").alias("rid"), F.col("Origin_airport").alias("airport"), F.col("dep_ts").alias("ts"),
        F.col("Type").alias("flight_type"))


REQ = """
req AS (SELECT ID AS rid, Origin_airport AS airport, dep_ts AS ts, Type AS flight_type,
               CASE WHEN Type = 'Long' THEN 'Big' END AS need_size
        FROM flight WHERE Status IN ('Active', 'Full'))"""

# where every aircraft stands: from each arrival to its next one
PLANE_STAY = """
flown AS (SELECT Airplane_ID, Arrival_airport, arr_ts FROM flight WHERE Status <> 'Canceled'),
landing AS (SELECT Airplane_ID, arr_ts, lead(arr_ts) OVER (PARTITION BY Airplane_ID ORDER BY arr_ts) AS until
            FROM (SELECT DISTINCT Airplane_ID, arr_ts FROM flown)),
plane_stay AS (SELECT DISTINCT Airplane_ID, Arrival_airport AS airport, arr_ts AS since, until FROM flown JOIN landing USING (Airplane_ID, arr_ts)),
idle_plane AS (SELECT a.* FROM airplane a ANTI JOIN flown ON flown.Airplane_ID = a.ID)"""

# where every crew member stands: from the latest completed leg and from each open leg to the next open departure
CREW_STAY = """
leg AS (SELECT aa.Aircrew_ID, f.dep_ts, f.arr_ts, f.Status, f.Arrival_airport AS airport FROM aircrew_assignment aa JOIN flight f ON f.ID = aa.Flight_ID),
latest AS (SELECT Aircrew_ID, max(arr_ts) AS arr_ts FROM leg WHERE Status = 'Completed' GROUP BY 1),
landed AS (SELECT Aircrew_ID, airport, arr_ts AS since, 'completed' AS branch FROM leg JOIN latest USING (Aircrew_ID, arr_ts) WHERE Status = 'Completed'
           UNION SELECT Aircrew_ID, airport, arr_ts, 'arriving' FROM leg WHERE Status IN ('Active', 'Full')),
takeoff AS (SELECT DISTINCT Aircrew_ID, dep_ts FROM leg WHERE Status IN ('Active', 'Full')),
crew_stay AS (SELECT l.*, t.dep_ts AS until FROM landed l ASOF LEFT JOIN takeoff t ON t.Aircrew_ID = l.Aircrew_ID AND l.since < t.dep_ts),
idle_crew AS (SELECT c.* FROM aircrew c ANTI JOIN aircrew_assignment aa ON aa.Aircrew_ID = c.ID),
idle_count AS (SELECT count(*) FILTER (Type = 'Pilot') AS p, count(*) FILTER (Type = 'Pilot' AND Training = 1) AS pt,
                      count(*) FILTER (Type <> 'Pilot') AS s, count(*) FILTER (Type <> 'Pilot' AND Training = 1) AS st FROM idle_crew)"""


def planes_at(r: str, x: str = "") -> str:
    """Aircraft that stand at the airport of each request of CTE ``r``, are not in the air and do not depart then."""
    return f"""
here{x} AS (SELECT DISTINCT r.rid, r.ts, a.ID AS Airplane_ID, a.Size, a.Manufacturer
  FROM {r} r JOIN plane_stay s ON s.airport = r.airport AND s.since <= r.ts AND coalesce(s.until > r.ts, true)
  JOIN airplane a ON a.ID = s.Airplane_ID AND a.Size = coalesce(r.need_size, a.Size)),
away{x} AS (SELECT h.rid, h.ts, h.Airplane_ID FROM here{x} h JOIN flight x ON x.Airplane_ID = h.Airplane_ID
  WHERE x.dep_ts = h.ts OR (x.Status IN ('Active', 'Full') AND h.ts BETWEEN x.dep_ts AND x.arr_ts AND h.ts < x.arr_ts)),
aloc{x} AS (SELECT rid, ts, Airplane_ID, Size, Manufacturer FROM here{x} ANTI JOIN away{x} USING (rid, ts, Airplane_ID))"""


def crew_at(r: str, x: str = "") -> str:
    """Crew that stand at the airport of each request and do not depart then."""
    return f"""
cloc{x} AS (SELECT DISTINCT r.rid, r.ts, s.Aircrew_ID
  FROM {r} r JOIN crew_stay s ON s.airport = r.airport AND s.since <= r.ts AND coalesce(s.until > r.ts, true)
  ANTI JOIN leg b ON b.Aircrew_ID = s.Aircrew_ID AND b.dep_ts = r.ts)"""


def feasible(r: str, x: str = "") -> str:
    """Counts of free aircraft and crew per request, located or idle, and what is short."""
    return f"""{planes_at(r, x)}, {crew_at(r, x)},
free_plane{x} AS (SELECT rid, ts FROM aloc{x} UNION ALL
  SELECT r.rid, r.ts FROM {r} r JOIN idle_plane i ON i.Size = coalesce(r.need_size, i.Size) ANTI JOIN flight x ON x.Airplane_ID = i.ID AND x.dep_ts = r.ts),
plane_count{x} AS (SELECT rid, ts, count(*) AS n FROM free_plane{x} GROUP BY 1, 2),
crew_count{x} AS (SELECT rid, ts, count(*) FILTER (Type = 'Pilot') AS p, count(*) FILTER (Type = 'Pilot' AND Training = 1) AS pt,
                         count(*) FILTER (Type <> 'Pilot') AS s, count(*) FILTER (Type <> 'Pilot' AND Training = 1) AS st
                  FROM cloc{x} JOIN aircrew a ON a.ID = Aircrew_ID GROUP BY 1, 2),
cnt{x} AS (SELECT r.rid, r.ts, CAST(CASE WHEN flight_type = 'Long' THEN 3 ELSE 2 END AS BIGINT) AS req_pilots,
                  CAST(CASE WHEN flight_type = 'Long' THEN 6 ELSE 3 END AS BIGINT) AS req_attendants, coalesce(k.n, 0) AS aircraft,
                  CASE WHEN flight_type = 'Long' THEN coalesce(c.pt, 0) + i.pt ELSE coalesce(c.p, 0) + i.p END AS pilots,
                  CASE WHEN flight_type = 'Long' THEN coalesce(c.st, 0) + i.st ELSE coalesce(c.s, 0) + i.s END AS attendants
           FROM {r} r CROSS JOIN idle_count i LEFT JOIN plane_count{x} k USING (rid, ts) LEFT JOIN crew_count{x} c USING (rid, ts)),
fz{x} AS (SELECT rid, ts, aircraft, pilots, attendants, req_pilots, req_attendants,
                 nullif(array_to_string(list_filter(['aircraft', 'pilots', 'attendants'],
                   lambda w: CASE w WHEN 'aircraft' THEN aircraft = 0 WHEN 'pilots' THEN pilots < req_pilots ELSE attendants < req_attendants END), ','), '') AS short_of
          FROM cnt{x})"""


@query("aircraft_available", f"WITH {REQ}, {PLANE_STAY}, {planes_at('req')} SELECT * FROM aloc")
def _d02(t):
    req = A.crew_requirement(requests_of(t), "type")
    return A.aircraft_available(t, req)


# every fifth aircraft has a twin that never flew
@query("aircraft_floating", """
SELECT ID AS Airplane_ID, Size, Manufacturer FROM (SELECT ID, Size, Manufacturer FROM airplane UNION ALL SELECT ID + 1000000000, Size, Manufacturer FROM airplane WHERE ID % 5 = 0)
WHERE ID NOT IN (SELECT Airplane_ID FROM flight WHERE Status IN ('Active', 'Full', 'Completed'))
""")
def _d02f(t):
    twins = t.airplane.where("ID % 5 = 0").withColumn("ID", F.col("ID") + 1000000000)
    return A.floating_aircraft(replace(t, airplane=t.airplane.unionByName(twins)))


@query("crew_available", f"""
WITH {REQ}, {CREW_STAY}, {crew_at('req')}
SELECT c.rid, c.ts, c.Aircrew_ID, a.Type, a.Training FROM cloc c JOIN aircrew a ON a.ID = c.Aircrew_ID
""")
def _d03(t):
    return A.crew_available(t, requests_of(t))


@query("crew_floating", """
SELECT ID AS Aircrew_ID, Type, Training FROM aircrew WHERE ID NOT IN (SELECT Aircrew_ID FROM aircrew_assignment)
""")
def _d03f(t):
    return A.floating_crew(t)


@query("crew_intervals", f"WITH {CREW_STAY.lstrip()} SELECT Aircrew_ID, airport, since AS from_ts, until AS to_ts, branch FROM crew_stay")
def _d04(t):
    return A.crew_intervals(t)


@query("crew_requirement", """
SELECT ID AS rid, Type AS flight_type, CASE WHEN Type = 'Long' THEN 'Big' END AS need_size,
       Type = 'Long' AS need_training, CASE WHEN Type = 'Long' THEN 3 ELSE 2 END AS req_pilots,
       CASE WHEN Type = 'Long' THEN 6 ELSE 3 END AS req_attendants
FROM flight
""")
def _d05(t):
    return A.crew_requirement(t.flight.select(F.col("ID").alias("rid"), F.col("Type").alias("flight_type")), "type")


FEAS = f"WITH {REQ}, {PLANE_STAY}, {CREW_STAY}, {feasible('req')}"


@query("feasibility", FEAS + "\nSELECT *, short_of IS NULL AS feasible FROM fz")
def _d06(t):
    return A.feasibility(t, requests_of(t))


# candidates: the 20 nearest later open arrivals at the airport and the 20 nearest later departures anywhere
EARLIEST = f"""
WITH {REQ}, {PLANE_STAY}, {CREW_STAY}, {feasible("req")},
bad AS (SELECT r.* FROM req r JOIN fz USING (rid) WHERE short_of IS NOT NULL),
arrival AS (SELECT DISTINCT Arrival_airport AS airport, arr_ts AS ts FROM flight WHERE Status IN ('Active', 'Full')),
departure AS (SELECT DISTINCT dep_ts AS ts FROM flight),
near_arr AS (SELECT b.rid, unnest(list_sort(list(a.ts))[:20]) AS ts FROM bad b JOIN arrival a ON a.airport = b.airport AND a.ts > b.ts GROUP BY 1),
near_dep AS (SELECT b.rid, unnest(list_sort(list(d.ts))[:20]) AS ts FROM bad b JOIN departure d ON d.ts > b.ts GROUP BY 1),
creq AS (SELECT b.rid, b.airport, c.ts, b.flight_type, b.need_size FROM bad b JOIN (SELECT * FROM near_arr UNION SELECT * FROM near_dep) c ON c.rid = b.rid),
{feasible("creq", "1")},
found AS (SELECT rid, min(ts) AS ts FROM fz1 WHERE short_of IS NULL GROUP BY 1),
fallback AS (SELECT rid, min(ts) AS ts FROM near_arr GROUP BY 1)
SELECT b.rid, b.ts, coalesce(found.ts, fallback.ts) AS suggested_ts FROM bad b LEFT JOIN found USING (rid) LEFT JOIN fallback USING (rid)
"""


@query("earliest_slot", EARLIEST)
def _d07(t):
    return A.earliest_slot(t, requests_of(t))


RECOMMEND = f"""
WITH {REQ}, {PLANE_STAY}, {CREW_STAY}, {feasible("req")},
choice AS (SELECT rid, ts, Airplane_ID, Size, Manufacturer FROM aloc UNION ALL
  SELECT r.rid, r.ts, i.ID, i.Size, i.Manufacturer FROM req r JOIN idle_plane i ON i.Size = coalesce(r.need_size, i.Size)
  ANTI JOIN flight x ON x.Airplane_ID = i.ID AND x.dep_ts = r.ts),
staffed AS (SELECT c.*, CASE Size WHEN 'Big' THEN 3 ELSE 2 END AS rp, CASE Size WHEN 'Big' THEN 6 ELSE 3 END AS ra FROM choice c),
rec AS (SELECT s.rid, s.ts, rp, ra, Airplane_ID FROM staffed s JOIN cnt USING (rid, ts) WHERE pilots >= rp AND attendants >= ra
        QUALIFY row_number() OVER (PARTITION BY s.rid, s.ts ORDER BY Size DESC, Manufacturer, Airplane_ID) = 1),
someone AS (SELECT rid, ts, Aircrew_ID FROM cloc UNION ALL SELECT rid, ts, idle_crew.ID FROM req, idle_crew),
ranked AS (SELECT p.rid, p.ts, a.ID, a.Type, row_number() OVER (PARTITION BY p.rid, p.ts, a.Type
             ORDER BY CASE WHEN r.flight_type = 'Long' THEN 0 ELSE -a.Training END, a.ID) AS pos
           FROM someone p JOIN req r USING (rid, ts) JOIN aircrew a ON a.ID = p.Aircrew_ID WHERE r.flight_type <> 'Long' OR a.Training = 1)
SELECT rid, ts, 'airplane' AS role, Airplane_ID AS member_id, CAST(1 AS BIGINT) AS pos FROM rec
UNION ALL
SELECT rid, ts, CASE Type WHEN 'Pilot' THEN 'pilot' ELSE 'attendant' END, ID, pos FROM ranked JOIN rec USING (rid, ts)
WHERE pos <= CASE Type WHEN 'Pilot' THEN rp ELSE ra END
"""


@query("crew_recommend", RECOMMEND)
def _d08(t):
    return A.crew_recommend(t, requests_of(t))
