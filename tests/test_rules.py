"""Rules that the registered queries' data can't reach: key order, NULLs, long chains, large ids, cluster settings."""

from datetime import datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from skyops.functions import exprs as X
from skyops.operators import booking as B
from skyops.session import ensure_checkpoint_dir
from skyops.sources import tables as S
from skyops.sources.airline import flight_code_of, ts_ntz


def test_flight_ids_are_never_cut(spark):
    keys = [1, 1234567, 12345678, 12345679, 10**12]
    got = [r.i for r in spark.createDataFrame([(k,) for k in keys], "k long").orderBy("k").select(flight_code_of(F.col("k")).alias("i")).collect()]
    assert got == ["F0000001", "F1234567", "F12345678", "F12345679", "F1000000000000"]


def test_flight_no_reads_leading_digits_of_f_ids(spark):
    rows = spark.createDataFrame([("F00012",), ("F12x",), ("Fx",), ("G99",), (None,)], "i string")
    assert [r.n for r in rows.select(X.flight_no(F.col("i")).alias("n")).collect()] == [12, 12, 0, 0, 0]


def test_update_reads_the_row_as_it_was(spark):
    rows = spark.createDataFrame([(1, "Active", 5.0), (2, "Full", 6.0)], "id int, status string, price double")
    out = S.update_where(rows, F.col("status") == "Active", {"status": "X", "price": F.length("status").cast("double")})
    assert sorted(map(tuple, out.collect())) == [(1, "X", 6.0), (2, "Full", 6.0)] and out.columns == rows.columns


def test_insert_and_upsert_pick_by_order_and_write_nulls(spark):
    target = spark.createDataFrame([("a", "old", 1), ("b", "old", 2)], "k string, v string, w int")
    new = spark.createDataFrame([("a", None, 1), ("a", "late", 2), ("c", "late", 9), ("c", "soon", 3)], "k string, v string, seq int")
    got = {r.k: (r.v, r.w) for r in S.upsert(target, new, ["k"], ["v"], ["seq"]).collect()}
    assert got == {"a": (None, 1), "b": ("old", 2), "c": ("soon", None)}
    rows = spark.createDataFrame([("a", "x", 5), ("d", "y", 7), ("d", "x", 8)], "k string, v string, w int")
    for order, want in ((["w"], ("y", 7)), (["v"], ("x", 8))):
        assert {r.k: (r.v, r.w) for r in S.insert_ignore(target, rows.repartition(3), ["k"], order).collect()}["d"] == want


def seats(spark, rows, held=()):
    """An airline of one flight; rows: (cart, request hour, seat row)."""
    ticket = spark.createDataFrame([("F1", "Regular", r, "A", 1) for r in range(2000)], "Flight_ID string, CLASS_Type string, SEAT_Row_num int, SEAT_Column_number string, Availability int")
    links = spark.createDataFrame([("F1", "Regular", r, "A", 7) for r in held], "Flight_ID string, CLASS_Type string, SEAT_Row_num int, SEAT_Column_number string, Order_ID long")
    booking = spark.createDataFrame([(7, "Active")], "ID long, Status string")
    carts = spark.createDataFrame([(c, datetime(2001, 1, 1, h), i, "F1", "Regular", r, "A") for i, (c, h, r) in enumerate(rows)],
                                  "cart_id string, request_ts timestamp_ntz, order_id long, Flight_ID string, CLASS_Type string, SEAT_Row_num int, SEAT_Column_number string")
    return SimpleNamespace(ticket=ticket, ticket_order=links, booking=booking), carts


def test_a_cart_with_two_instants_is_one_cart(spark):
    t, carts = seats(spark, [("a", 3, 1), ("a", 1, 2), ("b", 2, 2), ("c", 2, 9)], held=[9])
    got = {r.cart_id: (r.accepted, r.valid, r.n_seats, r.request_ts.hour) for r in B.cart_admission(t, carts).collect()}
    assert got == {"a": (True, True, 2, 1), "b": (False, True, 1, 2), "c": (False, False, 1, 2)}


def test_chains_of_carts_are_followed_to_the_end(spark):
    """Cart k wants the seats k and k + 1: every other one is accepted, and each waits for the one before."""
    n = 12
    t, carts = seats(spark, [(f"c{k:02d}", k, k + d) for k in range(n) for d in (0, 1)])
    got = {r.cart_id: r.accepted for r in B.cart_admission(t, carts).collect()}
    assert got == {f"c{k:02d}": k % 2 == 0 for k in range(n)}


def test_refused_requests_do_not_use_up_an_order(spark, t_small):
    order = t_small.booking.where("Status = 'Active' AND MEMBER_Email IS NOT NULL").join(
        t_small.ticket_order.select(F.col("Order_ID").alias("ID")).distinct(), "ID").orderBy("ID").first()
    own, other = order.MEMBER_Email, "x@example.com"
    req = spark.createDataFrame([(datetime(1998, 1, 1, h), order.ID, m, None) for h, m in ((1, other), (2, own), (3, other), (4, own))],
                                "request_ts timestamp_ntz, order_id long, req_member string, req_guest string")
    out = B.order_cancel(t_small, req, ts_ntz("1998-01-01 00:00:00"))[2].orderBy("request_ts").collect()
    assert [r.reason for r in out] == ["not owner", "ok", "not owner", "not active"]


def test_dense_index_is_consecutive_in_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = B.dense_index(rows.repartition(9), [F.col("v")]).collect()
    assert sorted((r.v, r.idx) for r in got) == [(v, v + 1) for v in range(1000)]


def test_class_rows_without_seats_have_a_reason(spark):
    rows = spark.createDataFrame([("Regular", 1, 2, 3), ("Regular", 2, 2, 27), ("Regular", 3, 0, 3), ("Regular", 4, None, 3)],
                                 "Type string, Airplane_ID long, Number_of_rows int, Number_of_columns int")
    assert B.seat_generate(rows).count() == 6
    assert {r.Airplane_ID: r.reason for r in B.seat_rejected(rows).collect()} == {2: "too many columns", 3: "no rows or columns", 4: "no rows or columns"}


def test_a_cluster_has_to_name_the_shared_folder():
    conf = SimpleNamespace(get=lambda *a: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(cluster)


def test_every_quality_rule_finds_its_seeded_violation(t_small):
    from skyops.operators import quality as Q
    from skyops.plans.q_quality import BROKEN, COPIES, DOMAIN_SQL, REQUIRED, with_broken_rows
    t = with_broken_rows(t_small)
    found = lambda df, *cols: {tuple(r) for r in df.select(*cols).distinct().collect()}
    assert found(Q.check_domain(t), "tbl", "rule") == {(tb, rule) for tb, rule, _ in DOMAIN_SQL}
    assert found(Q.check_unique(t), "tbl") == {(tb,) for tb in COPIES}
    assert found(Q.check_fk(t), "tbl", "parent") >= {(child, parent) for child, _, parent, _ in Q.FOREIGN_KEYS}
    assert found(Q.check_not_null(t), "tbl", "col") == {(tb, c) for tb, cols in REQUIRED.items() for c in cols}
    assert len(BROKEN) > 25
    for check in (Q.check_domain, Q.check_unique, Q.check_fk, Q.check_not_null):
        assert check(t_small).count() == 0


def test_white_space_around_form_values(spark):
    spaces = ["", " ", "\t", "\n", "\r\n", "\x0b\x0c", "\x1c", "\x85", " ", " ", "　"]
    df = spark.createDataFrame([(a + "Ann" + b, a + "5" + b) for a in spaces for b in spaces], "name string, n string")
    got = df.select(X.is_english_name("name").alias("ok"), X.positive_int("n").alias("n"), X.strip("name").alias("s")).distinct().collect()
    assert [tuple(r) for r in got] == [(True, 5, "Ann")]
    bad = spark.createDataFrame([("An\tn", "1 2"), ("", ""), (" \n", "\t"), (None, None), ("Ann​", "-5"), ("5", "0"), ("a-", "+5")], "name string, n string")
    assert not [r for r in bad.select(X.is_english_name("name").alias("ok"), X.positive_int("n").alias("n")).collect() if r.ok or r.n is not None]


def test_next_key_counts_only_its_own_series(spark):
    from skyops.operators import relational as Rel
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "ID string")
    most = lambda *x: Rel.next_key(ids(*x), "ID", prefix="F").first()[0]
    assert most("F00012", "F13x", "G00099", None) == 13
    assert (most("f20", "F3"), most("Fx9", "F-4"), most("G7"), Rel.next_key(ids("F1").limit(0), "ID", prefix="F").first()[0]) == (20, 0, 0, 0)
