"""Scalar functions on hand-made rows (the edge cases of the reference's helpers)."""

import datetime as dt


from skyops.functions import exprs as X


def _one(spark, col, schema, rows):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_to_ts_formats(spark):
    got = _one(spark, X.to_ts("d", "t"), "d string, t string",
               [("2024-01-02", "10:00"), ("2024-01-02", "10:00:30"), ("2024-01-02", "bad"), ("x", "10:00")])
    assert got == [dt.datetime(2024, 1, 2, 10), dt.datetime(2024, 1, 2, 10, 0, 30), None, None]


def test_english_name(spark):
    names = ["Anne-Marie", "O'Neil", "  Bob  ", "A", "-Bob", "Bob-", "José", "", "A" * 50, "A" * 51]
    got = _one(spark, X.is_english_name("n"), "n string", [(n,) for n in names])
    assert got == [True, True, True, True, False, False, False, False, True, False]


def test_positive_int(spark):
    got = _one(spark, X.positive_int("s"), "s string", [("12",), (" 7 ",), ("0",), ("-3",), ("1.5",), ("",), (None,)])
    assert got == [12, 7, None, None, None, None, None]


def test_flight_type_boundary(spark):
    assert _one(spark, X.flight_type("m"), "m int", [(360,), (361,)]) == ["Short", "Long"]


def test_adult_feb29(spark):
    got = _one(spark, X.adult_cutoff("d"), "d date", [(dt.date(2024, 2, 29),)])
    assert got == [dt.date(2006, 2, 28)]


def test_cancel_fee_half_up(spark):
    assert _one(spark, X.cancel_fee("x"), "x double", [(100.0,), (0.1,), (132870.3,)]) == [5.0, 0.01, 6643.52]


def test_currency_and_hm(spark):
    assert _one(spark, X.currency("x"), "x string", [("1234.5",), ("abc",)]) == ["$1,234.50", "abc"]
    assert _one(spark, X.hm("x"), "x string", [("10:05:00",), ("10:05",), (None,), ("soon",)]) == \
        ["10:05", "10:05", "", "soon"]


def test_seat_key_and_letters(spark):
    got = _one(spark, X.parse_seat_key("k"), "k string", [("Regular|3|B",), ("bad",), ("First|x|A",)])
    assert got[0].asDict() == {"cls": "Regular", "row": 3, "col": "B"} and got[1] is None and got[2] is None
    assert _one(spark, X.col_letter("n"), "n int", [(1,), (26,)]) == ["A", "Z"]


def test_pretty_headers():
    assert X.pretty_header("Total_Income") == "Total income ($)"
    assert X.pretty_header("Total_Flight_Hours") == "Total Flight Hours"
    assert X.pretty_header("flight_id") == "Flight ID"
    assert X.pretty_header("ym") == "Month"


def test_clamp_qty(spark):
    got = _one(spark, X.clamp_qty("q", "a"), "q string, a int", [("5", 3), ("0", 3), ("x", 3), ("2", 3)])
    assert got == [3, 1, 1, 2]
