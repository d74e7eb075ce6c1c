"""The skew-safe temporal operators equal their brute-force definitions."""

import datetime as dt
import random


from skyops.operators.intervals import interval_point_join, next_event_after


def _ts(r, lo=0, hi=3000):
    return dt.datetime(2000, 1, 1) + dt.timedelta(minutes=r.randint(lo, hi) * 17)


def test_interval_point_join_matches_brute_force(spark):
    r = random.Random(7)
    ivs = []
    for i in range(300):
        k = r.randint(0, 3)
        a = _ts(r)
        b = None if r.random() < 0.2 else a + dt.timedelta(minutes=r.randint(0, 20000))
        ivs.append((k, i, a, b))
    pts = [(r.randint(0, 3), j, _ts(r)) for j in range(200)]
    pts += [(ivs[i][0], 1000 + i, ivs[i][2]) for i in range(0, 300, 7)]  # boundary: t == from
    pts += [(ivs[i][0], 2000 + i, ivs[i][3]) for i in range(0, 300, 5) if ivs[i][3]]  # t == to (excluded)
    I = spark.createDataFrame(ivs, "k int, iid int, f timestamp_ntz, t timestamp_ntz")
    P = spark.createDataFrame(pts, "k int, pid int, ts timestamp_ntz")
    got = sorted((x.pid, x.iid) for x in interval_point_join(P, I, ["k"], "ts", "f", "t").collect())
    want = sorted((p[1], i[1]) for p in pts for i in ivs
                  if p[0] == i[0] and i[2] <= p[2] and (i[3] is None or p[2] < i[3]))
    assert got == want
    semi = sorted(x.pid for x in interval_point_join(P, I, ["k"], "ts", "f", "t", "left_semi").collect())
    assert semi == sorted({w[0] for w in want})
    anti = sorted(x.pid for x in interval_point_join(P, I, ["k"], "ts", "f", "t", "left_anti").collect())
    assert anti == sorted({p[1] for p in pts} - {w[0] for w in want})


def test_next_event_after_matches_brute_force(spark):
    r = random.Random(3)
    evs = [(r.randint(0, 2), _ts(r)) for _ in range(400)]
    pts = [(r.randint(0, 2), j, _ts(r)) for j in range(300)] + [(e[0], 900 + n, e[1]) for n, e in enumerate(evs[:50])]
    E = spark.createDataFrame(evs, "k int, e timestamp_ntz")
    P = spark.createDataFrame(pts, "k int, pid int, ts timestamp_ntz")
    got = {x.pid: x.nxt for x in next_event_after(P, E, ["k"], "ts", "e", "nxt").collect()}
    for k, pid, ts in pts:
        later = [e for kk, e in evs if kk == k and e > ts]
        assert got[pid] == (min(later) if later else None), pid


def test_count_covering_matches_brute_force(spark):
    from skyops.operators.intervals import count_covering
    r = random.Random(11)
    ivs = []
    for i in range(300):
        k = r.randint(0, 2)
        a = _ts(r)
        ivs.append((k, a, None if r.random() < 0.2 else a + dt.timedelta(minutes=r.randint(0, 20000))))
    pts = [(r.randint(0, 2), _ts(r)) for _ in range(200)] + [(i[0], i[1]) for i in ivs[:40]] + \
          [(i[0], i[2]) for i in ivs[40:80] if i[2]]
    I_ = spark.createDataFrame(ivs, "k int, f timestamp_ntz, t timestamp_ntz")
    P = spark.createDataFrame(pts, "k int, ts timestamp_ntz")
    got = {(x.k, x.ts): x.n for x in count_covering(P, I_, ["k"], "ts", "f", "t", "n").collect()}
    for k, ts in pts:
        want = sum(1 for kk, f, t in ivs if kk == k and f <= ts and (t is None or ts < t))
        assert got[(k, ts)] == want
