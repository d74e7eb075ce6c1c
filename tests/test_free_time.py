"""Counts, earliest slots and recommendations against a plain model of each instant, on random schedules full of ties."""

import datetime as dt
import random
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skyops.operators import availability as A
from skyops.operators import intervals as I

START = dt.datetime(2001, 1, 1, 22)
OPEN, NON_CANCELLED = ("Active", "Full"), ("Active", "Full", "Completed")


def at(step):
    return START + dt.timedelta(minutes=20 * step)


def schedule(seed, flights=40, planes=6, crew=14, airports="ABC", steps=14):
    rng = random.Random(seed)
    fl, assigned = [], set()
    for i in range(flights):
        dep = rng.randrange(steps)
        # some planes only ever have cancelled legs, some none; crew members 0 and 1 are never assigned
        plane = rng.randrange(planes)
        status = "Canceled" if plane < 2 else rng.choice(["Active", "Full", "Completed", "Completed", "Canceled"])
        if plane != planes - 1:
            fl.append((f"F{i:03}", plane, status, rng.choice(["Long", "Short"]), rng.choice(airports), rng.choice(airports), at(dep), at(dep + rng.randint(1, 4))))
            assigned |= {(c, f"F{i:03}") for c in rng.sample(range(2, crew), rng.randint(0, 4))}
    return SimpleNamespace(
        flight=fl, assigned=sorted(assigned), airplane=[(p, rng.choice(["Big", "Small"]), rng.choice(["M1", "M2"])) for p in range(planes)],
        aircrew=[(c, rng.choice(["Pilot", "Flight attendant"]), rng.randint(0, 1)) for c in range(crew)],
        requests=[(f"r{k}", rng.choice(airports + "D"), at(rng.randrange(-1, steps + 5)), rng.choice(["Long", "Short"])) for k in range(25)])


def tables(spark, s):
    t = SimpleNamespace(
        flight=spark.createDataFrame(s.flight, "ID string, Airplane_ID long, Status string, Type string, Origin_airport string, Arrival_airport string, dep_ts timestamp_ntz, arr_ts timestamp_ntz"),
        airplane=spark.createDataFrame(s.airplane, "ID long, Size string, Manufacturer string"),
        aircrew=spark.createDataFrame(s.aircrew, "ID long, Type string, Training int"),
        aircrew_assignment=spark.createDataFrame(s.assigned, "Aircrew_ID long, Flight_ID string"))
    return t, spark.createDataFrame(s.requests, "rid string, airport string, ts timestamp_ntz, flight_type string")


def planes_free(s, airport, t, need_big):
    out = []
    for p, size, maker in s.airplane:
        legs = [f for f in s.flight if f[1] == p]
        flown = [f for f in legs if f[2] in NON_CANCELLED]
        arrived = [f for f in flown if f[7] <= t]
        last = max((f[7] for f in arrived), default=None)
        here = not flown or any(f[7] == last and f[5] == airport for f in arrived)
        away = any(f[6] == t for f in legs) or any(f[2] in OPEN and f[6] <= t < f[7] for f in legs)
        if here and not away and (size == "Big" or not need_big):
            out.append((size, maker, p))
    return sorted(out, key=lambda x: (x[0] != "Small", x[1], x[2]))


def crew_free(s, airport, t, need_training):
    out = {"Pilot": [], "Flight attendant": []}
    for c, kind, training in s.aircrew:
        legs = [f for f in s.flight if (c, f[0]) in s.assigned]
        done = max((f[7] for f in legs if f[2] == "Completed"), default=None)
        arrivals = [f[7] for f in legs if f[5] == airport and (f[2] in OPEN or f[2] == "Completed" and f[7] == done)]
        here = not legs or any(a <= t and not any(f[2] in OPEN and a < f[6] <= t for f in legs) for a in arrivals)
        if here and not any(f[6] == t for f in legs) and (training or not need_training):
            out[kind].append((-training, c))
    return {k: [c for _, c in sorted(v)] for k, v in out.items()}


def judged(s, airport, t, kind):
    need = (3, 6) if kind == "Long" else (2, 3)
    planes, crew = planes_free(s, airport, t, kind == "Long"), crew_free(s, airport, t, kind == "Long")
    n = (len(planes), len(crew["Pilot"]), len(crew["Flight attendant"]))
    return n, n[0] > 0 and n[1] >= need[0] and n[2] >= need[1]


@pytest.mark.parametrize(("seed", "size"), [(2, {"crew": 40, "flights": 25}), (4, {"crew": 90, "flights": 120, "steps": 90})])
def test_random_schedules(spark, seed, size):
    s = schedule(seed, **size)
    t, requests = tables(spark, s)
    want = {r: judged(s, a, x, k) for r, a, x, k in s.requests}
    got = {r.rid: ((r.aircraft, r.pilots, r.attendants), r.feasible) for r in A.feasibility(t, requests).collect()}
    assert got == want

    slots = {}
    for r, airport, x, kind in s.requests:
        if not want[r][1]:
            arrivals = sorted({f[7] for f in s.flight if f[5] == airport and f[2] in OPEN and f[7] > x})[:20]
            departures = sorted({f[6] for f in s.flight if f[6] > x})[:20]
            good = [c for c in sorted({*arrivals, *departures}) if judged(s, airport, c, kind)[1]]
            slots[r] = (good or arrivals or [None])[0]
    assert {r.rid: r.suggested_ts for r in A.earliest_slot(t, requests).collect()} == slots

    chosen = set()
    for r, airport, x, kind in s.requests:
        crew = crew_free(s, airport, x, kind == "Long")
        for size, _, p in planes_free(s, airport, x, kind == "Long"):
            need = (3, 6) if size == "Big" else (2, 3)
            if len(crew["Pilot"]) >= need[0] and len(crew["Flight attendant"]) >= need[1]:
                chosen.add((r, "airplane", p, 1))
                chosen |= {(r, role, c, k + 1) for role, who, n in (("pilot", "Pilot", need[0]), ("attendant", "Flight attendant", need[1])) for k, c in enumerate(crew[who][:n])}
                break
    assert {(r.rid, r.role, r.member_id, r.pos) for r in A.crew_recommend(t, requests).collect()} == chosen


def test_no_pairs_in_the_plans(spark):
    """The joins of the counts and recommendations are equi joins on instants, epochs, ranks or nodes: nothing joins on the airport alone."""
    t, requests = tables(spark, schedule(5))
    for df in (A.feasibility(t, requests), A.crew_recommend(t, requests), A.earliest_slot(t, requests)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "PythonUDF" not in plan
        keys = [line.split("[", 2)[1].split("]")[0] for line in plan.splitlines() if "SortMergeJoin [" in line or "HashJoin [" in line]
        assert keys and not [k for k in keys if k.split("#")[0] == "airport" and "," not in k]


@pytest.mark.parametrize("seed", [0, 1])
def test_carry_scan(spark, seed):
    rng = random.Random(seed)
    rows = {(rng.choice("ab"), START + dt.timedelta(hours=rng.randrange(120), microseconds=rng.randrange(3))): (rng.randint(-2, 3), rng.choice([None, None, "x", "y"])) for _ in range(150)}
    df = spark.createDataFrame([(k, ts, n, p) for (k, ts), (n, p) in rows.items()], "k string, ts timestamp_ntz, n int, p string").repartition(5)
    got = {(r.k, r.ts): (r.n, r.p, r["next"]) for r in I.carry_scan(df, ["k"], "ts", ["n"], ["p"], "next").collect()}
    for key in "ab":
        total, last, mine = 0, None, sorted(ts for k, ts in rows if k == key)
        for i, ts in enumerate(mine):
            n, p = rows[key, ts]
            total, last = total + n, p or last
            assert got[key, ts] == (total, last, mine[i + 1] if i + 1 < len(mine) else None)


def test_rank_cover_is_a_partition_met_once(spark):
    ranges = spark.range(0, 34).withColumnRenamed("id", "lo").join(spark.range(0, 35).withColumnRenamed("id", "hi"), F.expr("lo <= hi"))
    blocks = {}
    for r in I.rank_cover(ranges, "lo", "hi").collect():
        blocks.setdefault((r.lo, r.hi), []).append((r["_lvl"], r["_k"]))
    for lo in range(34):
        for hi in range(lo, 35):
            mine = blocks.get((lo, hi), [])
            assert sorted(x for lvl, k in mine for x in range(k << lvl, (k + 1) << lvl)) == list(range(lo, hi))
            assert all(sum(lvl == other for other, _ in mine) <= 2 for lvl, _ in mine)
    above = I.enclosing_blocks(spark.range(0, 34).withColumn("n", F.lit(34).cast("long")), "id", F.col("n")).collect()
    assert {(r.id, r["_lvl"], r["_k"]) for r in above} == {(i, lvl, i >> lvl) for i in range(34) for lvl in range(6)}


def test_events_between(spark):
    ev = spark.createDataFrame([(k, at(x)) for k in (0, 1) for x in (0, 0, 1, 5, 80, 81)], "k int, e timestamp_ntz")
    pairs = spark.createDataFrame([(0, at(0), at(5)), (0, at(-1), at(200)), (1, at(1), at(1)), (1, at(2), None)], "k int, lo timestamp_ntz, hi timestamp_ntz")
    assert sorted((r.k, r.n) for r in I.events_between(pairs, ev, ["k"], "lo", "hi", "e", "n").collect()) == [(0, 2), (0, 5), (1, 0)]
    assert sorted(r.n for r in I.events_between(pairs, ev, [], "lo", "hi", "e", "n").collect()) == [0, 2, 5]
