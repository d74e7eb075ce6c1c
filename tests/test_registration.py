"""Checkout against a form-by-form model, and registrations with several forms of one key."""

import dataclasses
import datetime as dt
import random

from pyspark.sql import functions as F

from skyops.operators import registration as R
from skyops.operators.booking import SEAT4, SEAT5
from skyops.plans.q_registration import checkout_forms
from skyops.sources.airline import ts_ntz

AS_OF = dt.datetime(1999, 4, 10)  # in the midst of the flights of the small tables


def model(forms, seats, flights, tickets, held, members):
    """One checkout after another, in order of arrival → reason per cart, and the told names and phones."""
    sold, reasons, names, phones = set(), {}, {}, set()
    for f in sorted(forms, key=lambda f: (f["request_ts"], f["order_id"], f["cart_id"])):
        mine = seats.get(f["cart_id"], set())
        login, email, first, last, phone = ((f[c] or "").strip() for c in R.FORM)
        who = login or email
        if not mine:
            reason = "no seats"
        elif any(s[0] not in flights for s in mine):
            reason = "flight not found"
        elif any(flights[s[0]] <= AS_OF for s in mine):
            reason = "departed"
        elif any(tickets.get(s) != 1 or s in sold for s in mine):
            reason = "seat not available"
        elif not (who and first and last and phone):
            reason = "missing details"
        elif not first.isascii() or not first.isalpha():
            reason = "first name not English"
        elif not last.isascii() or not last.isalpha():
            reason = "last name not English"
        elif login and login not in members:
            reason = "no such member"
        elif not login and email in members:
            reason = "member must log in"
        else:
            names[bool(login), who] = (first, last)
            phones.add((bool(login), who, phone))
            reason = "seat held" if mine & held else "ok"
            if reason == "ok":
                sold |= mine
        reasons[f["cart_id"]] = reason
    return reasons, names, phones, sold


def test_checkout_equals_one_after_another(spark, t_small):
    r = random.Random(4)
    flights = {x.ID: x.dep_ts for x in t_small.flight.collect()}
    tickets = {tuple(x[c] for c in SEAT4): x.Availability for x in t_small.ticket.collect()}
    late = sorted(s for s in tickets if flights[s[0]] > AS_OF)[:60]
    members = sorted(x.Email for x in t_small.member.collect())
    guests = sorted(x.Email for x in t_small.guest.collect())
    # two held seats whose tickets still look available
    free = [s for s in late if tickets[s] == 1]
    order = t_small.booking.where("Status = 'Active'").first().ID
    plane = {tuple(x[c] for c in SEAT4): x.Airplane_ID for x in t_small.ticket.collect()}
    extra = [(*s, plane[s], order) for s in free[:2]]
    links = spark.createDataFrame(extra, "Flight_ID string, CLASS_Type string, SEAT_Row_num int, SEAT_Column_number string, Airplane_ID long, Order_ID long")
    t = dataclasses.replace(t_small, ticket_order=t_small.ticket_order.unionByName(links.select(*t_small.ticket_order.columns)))
    held = {tuple(s) for s in free[:2]}
    held |= {tuple(x[c] for c in SEAT4) for x in R.active_links(t_small).collect()}
    gone = next(s for s in sorted(tickets) if flights[s[0]] <= AS_OF)
    forms, seats = [], []
    for i in range(150):
        cart = f"c{i:03d}"
        who = r.choice([(r.choice(members), None), (None, r.choice(guests)), (None, r.choice(members)), (None, f"new{i % 5}@x"), ("nobody@x", None), (None, None)])
        forms.append((cart, AS_OF + dt.timedelta(minutes=r.randrange(40)), r.randrange(5), *who, r.choice([" Ann ", "Bo", "Zoë", ""]) if r.random() < 0.4 else "Cy",
                      r.choice(["Lee", "O3"]) if r.random() < 0.3 else "Li\t", r.choice(["1", " 2 ", "3", None]) if r.random() < 0.3 else str(i % 7)))
        for s in r.sample(late, r.choice([1, 1, 2, 3])) if i % 25 else []:
            seats.append((cart, *s))
        if i % 25 == 1:
            seats.append((cart, *gone))
        if i % 25 == 2:
            seats.append((cart, "nowhere", "Regular", 1, "A"))
        if i % 25 == 3:
            seats.append((cart, late[0][0], "Regular", 999, "A"))
    columns = ["cart_id", "request_ts", "order_id", *R.FORM]
    fdf = spark.createDataFrame([*forms, forms[0]], "cart_id string, request_ts timestamp_ntz, order_id long, login string, email string, first string, last string, phone string")
    sdf = spark.createDataFrame(seats, "cart_id string, Flight_ID string, CLASS_Type string, SEAT_Row_num int, SEAT_Column_number string")
    by_cart = {}
    for c, *s in seats:
        by_cart.setdefault(c, set()).add(tuple(s))
    reasons, names, phones, sold = model([dict(zip(columns, f)) for f in forms], by_cart, flights, tickets, held, set(members))
    done = R.checkout(t, fdf, sdf, ts_ntz(str(AS_OF)))
    got = {x.cart_id: x for x in done.outcomes.collect()}
    assert {c: x.reason for c, x in got.items()} == reasons
    assert set(reasons.values()) == {"no seats", "flight not found", "departed", "seat not available", "missing details", "first name not English",
                                     "last name not English", "no such member", "member must log in", "seat held", "ok"}
    assert {tuple(x[c] for c in SEAT4) for x in done.sold.collect()} == sold
    ids = sorted(x.ID for x in got.values() if x.ID is not None)
    top = t_small.booking.agg(F.max("ID")).first()[0]
    assert ids == list(range(top + 1, top + 1 + len(ids))) == sorted(x.ID for x in done.booking.collect())
    told = {(True, x.Email): (x.First_name_in_English, x.Last_name_in_English) for x in done.members.collect()}
    told |= {(False, x.Email): (x.First_name_in_English, x.Last_name_in_English) for x in done.guests.collect()}
    assert told == names
    assert {x.Email: x.is_new for x in done.guests.collect()} == {w: w not in guests for m, w in names if not m}
    known = {(True, x.Email, x.Phone_number) for x in t_small.phone_number_member.collect()} | {(False, x.Email, x.Phone_number) for x in t_small.phone_number_guest.collect()}
    assert {(x.kind == "member", x.Email, x.Phone_number) for x in done.phones.collect()} == phones - known


def test_checkout_writes_no_more_than_the_forms(t_small):
    forms, seats = checkout_forms(t_small)
    done = R.checkout(t_small, forms.limit(0), seats.limit(0), ts_ntz(str(AS_OF)))
    assert [x.count() for x in (done.outcomes, done.booking, done.links, done.sold, done.members, done.guests, done.phones)] == [0] * 7


def test_one_form_of_each_key_is_accepted(spark, t_small):
    columns = "airplane_id string, purchase_date string, manufacturer string, size string, reg_rows string, reg_cols string, first_rows string, first_cols string"
    rows = [("900001", "1998-01-01", m, "Big", "2", "3", "1", "2") for m in ("B", "A", "C", "A")] + [("900002", "1998-01-01", "B", "Small", "1", "1", "9", "9"), ("900001", None, "A", "Big", "1", "1", "1", "1")]
    outcomes, airplane, klass, seat = R.register_aircraft(spark.createDataFrame(rows, columns), t_small, ts_ntz(str(AS_OF)))
    assert sorted((x.manufacturer, x.size, x.reason) for x in outcomes.collect()) == [
        ("A", "Big", "missing field"), ("A", "Big", "ok"), ("B", "Big", "id exists"), ("B", "Small", "ok"), ("C", "Big", "id exists")]
    assert sorted((x.ID, x.Manufacturer) for x in airplane.collect()) == [(900001, "A"), (900002, "B")]
    assert klass.count() == 3 and sorted((x.Airplane_ID, x.Class_Type, x.Row_num, x.Column_number) for x in seat.collect()) == sorted(
        [(900001, "Regular", i, c) for i in (1, 2) for c in "ABC"] + [(900001, "First", 1, c) for c in "AB"] + [(900002, "Regular", 1, "A")])


def test_links_carry_the_whole_seat_key(t_small):
    forms, seats = checkout_forms(t_small)
    done = R.checkout(t_small, forms, seats, ts_ntz(str(AS_OF)))
    links = done.links.collect()
    assert len(links) == done.booking.count() > 0
    assert done.links.join(t_small.ticket.where("Availability = 1"), SEAT5, "left_anti").count() == 0
