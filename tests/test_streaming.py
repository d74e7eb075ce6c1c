"""Streaming operators: the stream equals the batch operator; replayed batches are skipped."""

import os
import tempfile

from pyspark.sql import functions as F

from skyops.operators.booking import SEAT4, active_links, seat_admission
from skyops.plans.q_booking import rebook_requests
from skyops.streaming.admission import REQUEST_SCHEMA, stream_seat_admission
from skyops.streaming.status import _versions, compact, current, stream_status_refresh
from skyops.operators.booking import status_refresh
from skyops.sources.airline import ts_ntz


def test_stream_seat_admission_equals_batch(spark, t_small):
    d = tempfile.mkdtemp(prefix="skyops-t02-", dir="/tmp")
    req = rebook_requests(t_small).select(*REQUEST_SCHEMA.fieldNames())
    # arrive in request order, in three files
    bounds = req.select(F.percentile_approx(F.unix_micros(F.col("request_ts").cast("timestamp")), [0.33, 0.66])
                        .alias("q")).first()["q"]
    us = F.unix_micros(F.col("request_ts").cast("timestamp"))
    parts = [req.where(us <= bounds[0]), req.where((us > bounds[0]) & (us <= bounds[1])), req.where(us > bounds[1])]
    src = os.path.join(d, "in")
    for i, p in enumerate(parts):
        p.coalesce(1).write.mode("overwrite").parquet(os.path.join(src, f"part{i}"))
    # flatten into one directory, oldest first
    flat = os.path.join(d, "flat")
    os.makedirs(flat)
    import shutil
    import time
    for i in range(3):
        for f in sorted(os.listdir(os.path.join(src, f"part{i}"))):
            if f.endswith(".parquet"):
                shutil.copy(os.path.join(src, f"part{i}", f), os.path.join(flat, f"{i}-{f}"))
                time.sleep(0.05)
    out = os.path.join(d, "out")
    q = stream_seat_admission(spark, flat, t_small, out, os.path.join(d, "ck"), trigger={"availableNow": True},
                              max_files_per_trigger=1)
    q.awaitTermination(300)
    got = spark.read.parquet(out).select("order_id", "Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number")
    want = seat_admission(t_small, req).where("accepted").select("order_id", "Flight_ID", "CLASS_Type", "SEAT_Row_num",
                                                                 "SEAT_Column_number")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    # at most one accepted request per seat
    assert got.groupBy("Flight_ID", "CLASS_Type", "SEAT_Row_num", "SEAT_Column_number").count().where("count > 1").count() == 0
    # restarting on the same checkpoint replays nothing and the sink keeps its rows exactly once
    n_before = spark.read.parquet(out).count()
    q2 = stream_seat_admission(spark, flat, t_small, out, os.path.join(d, "ck"), trigger={"availableNow": True},
                               max_files_per_trigger=1)
    q2.awaitTermination(300)
    assert spark.read.parquet(out).count() == n_before


def _requests_file(spark, path, rows):
    spark.createDataFrame(rows, REQUEST_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def test_seat_state_over_batches(spark, t_small, tmp_path):
    """A late file with an earlier request does not take a sold seat; an unsold seat stays open; a batch whose output is lost is written again as it was."""
    import datetime as dt
    free = (t_small.ticket.where("Availability = 1").join(active_links(t_small).select(*SEAT4), SEAT4, "left_anti").orderBy(*SEAT4).select(*SEAT4).limit(3).collect())
    gone = t_small.ticket.where("Availability = 0").orderBy(*SEAT4).select(*SEAT4).first()
    a, b, c = (tuple(x) for x in free)
    at = lambda m: dt.datetime(2001, 1, 1, 0, m)
    src, out, ck = (str(tmp_path / x) for x in ("in", "out", "ck"))

    def go():
        stream_seat_admission(spark, src, t_small, out, ck, trigger={"availableNow": True}).awaitTermination(300)
        return {(r.order_id, (r.Flight_ID, r.CLASS_Type, r.SEAT_Row_num, r.SEAT_Column_number), r.batch_id) for r in spark.read.parquet(out).collect()}

    _requests_file(spark, src, [(at(5), 11, "x", *a), (at(5), 10, None, *a), (at(6), 12, "x", *b), (at(1), 13, "x", *gone), (at(1), 14, "x", "none", "Regular", 1, "A")])
    first = {(10, a, 0), (12, b, 0)}
    assert go() == first
    _requests_file(spark, src, [(at(1), 20, "late", *a), (at(9), 21, "x", *c), (at(9), 22, "x", *c), (at(0), 23, "x", *gone)])
    second = first | {(21, c, 1)}
    assert go() == second and go() == second
    # the state, not the sink, remembers: nothing of the earlier output is there any more
    os.rename(out, out + "-moved")
    _requests_file(spark, src, [(at(0), 30, "x", *a), (at(0), 31, "x", *b), (at(0), 32, "x", *c)])
    stream_seat_admission(spark, src, t_small, out, ck, trigger={"availableNow": True}).awaitTermination(300)
    assert spark.read.parquet(f"{out}/batch=2").count() == 0
    # a batch that ran but was not committed runs again on the same state
    os.remove(f"{ck}/commits/2")
    for crc in (x for x in os.listdir(f"{ck}/commits") if x.startswith(".2")):
        os.remove(f"{ck}/commits/{crc}")
    stream_seat_admission(spark, src, t_small, out, ck, trigger={"availableNow": True}).awaitTermination(300)
    assert spark.read.parquet(f"{out}/batch=2").count() == 0


def test_stream_status_refresh(spark, t_small, tmp_path):
    import datetime as dt
    ticks, out, ck = (str(tmp_path / x) for x in ("ticks", "out", "ck"))

    def go(*instants, every=100):
        for x in instants:
            spark.createDataFrame([(x,)], "as_of timestamp_ntz").coalesce(1).write.mode("append").parquet(ticks)
        stream_status_refresh(spark, ticks, t_small, out, ck, trigger={"availableNow": True}, compact_every=every, max_files_per_trigger=1).awaitTermination(300)

    def check(as_of):
        want = [df.select("ID", "Status") for df in status_refresh(t_small, ts_ntz(as_of))]
        for got, expected, base in zip(current(spark, out, t_small), want, (t_small.flight, t_small.booking), strict=True):
            assert got.columns == base.columns and got.count() == base.count()
            assert got.select("ID", "Status").exceptAll(expected).count() == 0

    check("1900-01-01 00:00:00")
    go(dt.datetime(2001, 3, 1))
    check("2001-03-01 00:00:00")
    go(dt.datetime(2001, 3, 2), dt.datetime(2001, 2, 1), dt.datetime(2001, 6, 1))   # the third tick is late
    check("2001-06-01 00:00:00")
    # a tick writes what departed since the last one, not the table
    rows = [spark.read.parquet(f"{out}/v={v}/flight").count() for v in range(4)]
    due = [t_small.flight.where(F.col("Status").isin("Active", "Full") & F.col("dep_ts").between(ts_ntz(a), ts_ntz(b))).count()
           for a, b in (("1900-01-01", "2001-03-01"), ("2001-03-01 00:00:01", "2001-03-02"), ("2001-03-02 00:00:01", "2001-06-01"))]
    assert sum(rows) == sum(due) and rows[0] == due[0] and rows[1] == due[1] and sorted(rows[2:]) == [0, due[2]]
    # restarting replays nothing; folding changes nothing that readers see; later ticks go on from it
    go()
    assert _versions(spark, out) == [0, 1, 2, 3]
    compact(spark, t_small, out)
    compact(spark, t_small, out)
    assert _versions(spark, out, "folded") == [3]
    check("2001-06-01 00:00:00")
    go(dt.datetime(2001, 7, 1), every=1)
    assert _versions(spark, out, "folded") == [3, 4]
    check("2001-07-01 00:00:00")
