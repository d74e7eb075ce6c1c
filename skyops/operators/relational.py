"""Generic relational building blocks (P-, J-, A-, W-, O-, U- items of the inventory).

They are thin, typed compositions of DataFrame operators so that callers state intent
(``left_top1``, ``with_exists``…) and Catalyst still sees one declarative plan. The two
skew-sensitive ones — the next-event window and the interval/point join — live in
:mod:`skyops.operators.intervals`.
"""

from __future__ import annotations

import functools
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyops.functions import exprs as X


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


# ---- P: projections and predicates ----------------------------------------------------------

def project(df: DataFrame, exprs: Sequence) -> DataFrame:
    """P-01: projection with aliases; ``'*'`` keeps every input column."""
    return df.select(*exprs)


def case_when(df: DataFrame, out: str, cases: Sequence[tuple[Column, object]], default=None) -> DataFrame:
    """P-02: ``CASE WHEN p1 THEN v1 … ELSE default END AS out``."""
    e = None
    for pred, val in cases:
        v = val if isinstance(val, Column) else F.lit(val)
        e = F.when(pred, v) if e is None else e.when(pred, v)
    if default is not None:
        e = e.otherwise(default if isinstance(default, Column) else F.lit(default))
    return df.withColumn(out, e)


def with_const(df: DataFrame, name: str, value) -> DataFrame:
    """P-03: literal column."""
    return df.withColumn(name, F.lit(value))


def where_given(df: DataFrame, preds: dict[Column, object] | Iterable[tuple[object, Column]]) -> DataFrame:
    """P-04: conjunction of the predicates whose parameter is not None (seed ``TRUE``).

    ``preds`` maps a parameter value to the predicate built from it, given as pairs
    ``(value, predicate)``; a ``None`` value drops its predicate.
    """
    items = preds.items() if isinstance(preds, dict) else preds
    conds = [p for v, p in items if v is not None]
    return df.where(functools.reduce(operator.and_, conds, F.lit(True)))


def where_status(df: DataFrame, statuses: Sequence[str], col: str = "Status") -> DataFrame:
    """P-05: status membership."""
    return df.where(F.col(col).isin(*statuses))


def not_departed(flight: DataFrame, as_of: Column) -> DataFrame:
    """P-06: ``dep_ts >= as_of`` (pushes down to the parquet scan of a stored ``dep_ts``)."""
    return flight.where(F.col("dep_ts") >= as_of)


def departed(flight: DataFrame, as_of: Column) -> DataFrame:
    """P-06: ``dep_ts <= as_of``."""
    return flight.where(F.col("dep_ts") <= as_of)


def like_any(q: str, cols: Sequence) -> Column:
    """P-07 predicate: substring, ASCII case-insensitive; ``%``/``_`` in ``q`` stay wildcards."""
    pat = f"%{q}%"
    return functools.reduce(operator.or_, [_c(c).cast("string").ilike(pat) for c in cols])


def search_like(df: DataFrame, q: str | None, cols: Sequence) -> DataFrame:
    """P-07: keep rows where any of ``cols`` contains ``q`` (no-op when ``q`` is empty)."""
    if not q:
        return df
    return df.where(like_any(q, cols))


def filter_keys(df: DataFrame, keys_df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """P-08: multi-column key membership (``(a,b) IN (…)``) as a left-semi join."""
    return df.join(keys_df.select(*cols), list(cols), "left_semi")


def all_trained(selection: DataFrame, aircrew: DataFrame, by: str) -> DataFrame:
    """P-09: per ``by`` group of selected crew ids, whether every selected member is trained."""
    return (selection.join(aircrew.select(F.col("ID").alias("Aircrew_ID"), "Training"), "Aircrew_ID", "left")
            .groupBy(by).agg(F.every(F.coalesce(F.col("Training") == 1, F.lit(False))).alias("all_trained")))


def owned_by(member_email: Column, guest_email: Column, req_member: Column, req_guest: Column,
             status: Column) -> Column:
    """P-10: ownership with three-valued logic made explicit: NULL owners never match; a guest
    (anonymous) requester also needs an Active order."""
    m = F.coalesce(member_email == req_member, F.lit(False))
    g = F.coalesce((guest_email == req_guest) & (status == "Active"), F.lit(False))
    return m | g


def crew_filter(aircrew: DataFrame, id=None, name=None, role=None, training=None) -> DataFrame:
    """P-11: id equality (only when the text is digits), name contains, role =, training =."""
    id_s = str(id).strip() if id is not None else None
    full = F.lower(F.concat_ws(" ", "First_name", "Last_name"))
    return where_given(aircrew, [
        (id_s if id_s and id_s.isdigit() else None, F.col("ID") == F.lit(int(id_s) if id_s and id_s.isdigit() else 0)),
        (name or None, full.contains((name or "").strip().lower())),
        (role or None, F.col("Type") == F.lit(role)),
        (training, F.col("Training") == F.lit(training)),
    ])


def aircraft_filter(airplane: DataFrame, id_part=None, manufacturer=None, size=None) -> DataFrame:
    """P-12: id contains, manufacturer contains (case-insensitive), size equals."""
    return where_given(airplane, [
        (id_part or None, F.col("ID").cast("string").contains(str(id_part or ""))),
        (manufacturer or None, F.lower("Manufacturer").contains((manufacturer or "").lower())),
        (size or None, F.col("Size") == F.lit(size)),
    ])


# ---- J: joins ----------------------------------------------------------------------------

def semi(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """J-06: uncorrelated ``IN (sub-query)``."""
    return df.join(other, on, "left_semi")


def anti(df: DataFrame, other: DataFrame, on) -> DataFrame:
    """J-07: ``NOT IN`` / ``NOT EXISTS`` on non-null keys."""
    return df.join(other, on, "left_anti")


def with_exists(df: DataFrame, other: DataFrame, on: Sequence[str], flag: str) -> DataFrame:
    """J-08: boolean column — does a matching row exist in ``other``? (left join on distinct keys)."""
    keys = other.select(*on).distinct().withColumn(flag, F.lit(True))
    return df.join(keys, list(on), "left").withColumn(flag, F.coalesce(F.col(flag), F.lit(False)))


def left_top1(left: DataFrame, right: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """J-05: left join to the first row of ``right`` per ``keys`` under ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    top = right.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
    return left.join(top, list(keys), "left")


def with_label(df: DataFrame, labels: DataFrame, code_col: str, out: str = "label",
               lab_code: str = "Code", lab_label: str = "Label") -> DataFrame:
    """J-13: dictionary lookup with fallback to the code. ``labels`` is a dimension table."""
    lab = labels.select(F.col(lab_code).alias("_code"), F.col(lab_label).alias("_label"))
    return (df.join(lab, F.col(code_col) == F.col("_code"), "left")
            .withColumn(out, F.coalesce(F.col("_label"), F.col(code_col))).drop("_code", "_label"))


def ticket_stats(ticket: DataFrame) -> DataFrame:
    """J-14: per flight — min Regular price, min First price, total and available tickets —
    in one aggregate (replaces four correlated sub-queries)."""
    return ticket.groupBy("Flight_ID").agg(
        F.min(F.when(F.col("CLASS_Type") == "Regular", F.col("Price"))).alias("price_regular"),
        F.min(F.when(F.col("CLASS_Type") == "First", F.col("Price"))).alias("price_first"),
        F.count(F.lit(1)).alias("total_tickets"),
        F.count_if(F.col("Availability") == 1).alias("available_tickets"))


def first_phone(people: DataFrame, phone: DataFrame, key: str = "Email") -> DataFrame:
    """J-16: smallest phone per person (``ORDER BY phone LIMIT 1`` correlated), NULL if none."""
    return people.join(phone.groupBy(key).agg(F.min("Phone_number").alias("Phone_number")), key, "left")


# ---- A: aggregates ---------------------------------------------------------------------

def avg_ratio_pct(df: DataFrame, num: str, den: str) -> Column:
    """A-01: ``AVG(num / den) * 100`` with division by zero → NULL (ignored by AVG)."""
    ratio = F.when(F.col(den) != 0, F.col(num).cast("double") / F.col(den).cast("double"))
    return F.avg(ratio) * 100


def sum_by(df: DataFrame, keys: Sequence, measure: str, out: str) -> DataFrame:
    """A-02: SUM by keys."""
    return df.groupBy(*keys).agg(F.sum(measure).alias(out))


def count_where(df: DataFrame, keys: Sequence, preds: dict[str, Column]) -> DataFrame:
    """A-03: conditional counts, one column per named predicate."""
    return df.groupBy(*keys).agg(*[F.count_if(p).alias(n) for n, p in preds.items()])


def distinct_days_where(df: DataFrame, keys: Sequence, ts: str, pred: Column, out: str) -> DataFrame:
    """A-04: ``COUNT(DISTINCT CASE WHEN pred THEN DATE(ts) END)`` (exact)."""
    return df.groupBy(*keys).agg(F.count_distinct(F.when(pred, F.to_date(ts))).alias(out))


def rate_pct(df: DataFrame, keys: Sequence, pred: Column, out: str) -> DataFrame:
    """A-05: share of rows matching ``pred`` in %, half-up to 2 decimals."""
    from skyops.functions.exprs import half_up
    return df.groupBy(*keys).agg(half_up(F.count_if(pred).cast("double") / F.count(F.lit(1)) * 100, 2).alias(out))


def hours_by(df: DataFrame, keys: Sequence, minutes: str, out: str) -> DataFrame:
    """A-06: ``COALESCE(ROUND(SUM(min) / 60.0, 2), 0)``."""
    from skyops.functions.exprs import half_up
    return df.groupBy(*keys).agg(
        F.coalesce(half_up(F.sum(minutes).cast("double") / 60.0, 2), F.lit(0.0)).alias(out))


def seat_counts(airplane: DataFrame, seat: DataFrame) -> DataFrame:
    """A-08: regular / non-regular / total seats per aircraft; COUNT(*) over a LEFT JOIN, so an
    aircraft without seats reports total 1 (as the reference)."""
    per = seat.groupBy("Airplane_ID").agg(
        F.count_if(F.col("Class_Type") == "Regular").alias("regular_seats"),
        F.count_if(F.col("Class_Type") != "Regular").alias("first_seats"),
        F.count(F.lit(1)).alias("n"))
    return (airplane.join(per.withColumnRenamed("Airplane_ID", "ID"), "ID", "left")
            .select("ID", "Manufacturer", "Size",
                    F.coalesce("regular_seats", F.lit(0)).cast("long").alias("regular_seats"),
                    F.coalesce("first_seats", F.lit(0)).cast("long").alias("first_seats"),
                    F.coalesce("n", F.lit(1)).cast("long").alias("total_seats")))


def concat_where(df: DataFrame, keys: Sequence, order_col: str, label: Column, pred: Column,
                 out: str, sep: str = ", ") -> DataFrame:
    """A-09: conditional GROUP_CONCAT ordered by ``order_col``; NULL when nothing matches."""
    items = F.array_sort(F.collect_list(F.when(pred, F.struct(F.col(order_col).alias("o"), label.alias("l")))))
    s = F.array_join(F.transform(items, lambda x: x["l"]), sep)
    return df.groupBy(*keys).agg(F.when(F.size(items) > 0, s).alias(out))


def distinct_sorted(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A-10: DISTINCT values, sorted."""
    return df.select(*cols).distinct().orderBy(*cols)


def next_key(df: DataFrame, col: str, prefix: str | None = None) -> DataFrame:
    """A-11: ``IFNULL(MAX(id), 0)``; with a prefix, the largest number right behind it, over the ids that start with it in
    either case (leading digits count, an id without any counts as 0)."""
    v = F.col(col)
    if prefix:
        v = F.when(F.lower(v).startswith(prefix.lower()), X.lenient_int(F.substring(v, len(prefix) + 1, 1 << 20)))
    return df.agg(F.coalesce(F.max(v), F.lit(0).cast("long")).cast("long").alias("max_key"))


def reaggregate(report: DataFrame, keys: Sequence, measure: str, out: str) -> DataFrame:
    """A-12: second-level SUM over report rows, half-up to 2 decimals."""
    from skyops.functions.exprs import half_up
    return report.groupBy(*keys).agg(half_up(F.sum(measure), 2).alias(out))


def pivot_fill(df: DataFrame, row: str, col: str, measure: str, values: Sequence[str]) -> DataFrame:
    """A-14: rows × given column values, missing cells 0. Explicit ``values`` avoid a
    distinct-values job and bound the output width."""
    return (df.groupBy(row).pivot(col, list(values)).agg(F.sum(measure))
            .fillna(0.0, subset=list(values)).orderBy(row))


def seat_map(ticket: DataFrame) -> DataFrame:
    """A-15: per flight, ``class → [(row, [seat…])]`` ordered by row and column letter."""
    per_row = (ticket.groupBy("Flight_ID", "CLASS_Type", "SEAT_Row_num")
               .agg(F.array_sort(F.collect_list(F.struct("SEAT_Column_number", "Availability"))).alias("seats")))
    per_class = (per_row.groupBy("Flight_ID", "CLASS_Type")
                 .agg(F.array_sort(F.collect_list(F.struct(F.col("SEAT_Row_num").alias("row"), "seats"))).alias("rows")))
    return per_class.groupBy("Flight_ID").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("CLASS_Type", "rows")))).alias("seat_map"))


def cart_total(cart: DataFrame, ticket: DataFrame, cart_key: Sequence[str], seat_key: Sequence[str]) -> DataFrame:
    """A-16: total list price of the tickets in each cart."""
    return (cart.join(ticket.select(*seat_key, "Price"), list(seat_key), "inner")
            .groupBy(*cart_key).agg(F.sum("Price").alias("cart_total")))


# ---- W / O: windows, sorts, top-k ----------------------------------------------------------

def latest_rows(df: DataFrame, keys: Sequence[str], ts: str) -> DataFrame:
    """W-02: rows whose ``ts`` equals the group maximum (ties kept) — ``max`` aggregate joined
    back, which is a partial/final hash aggregate instead of a per-group sort."""
    mx = df.groupBy(*keys).agg(F.max(ts).alias("_mx"))
    return (df.join(mx, list(keys), "inner").where(F.col(ts) == F.col("_mx")).drop("_mx"))


def sort_by(df: DataFrame, specs: Sequence[Column]) -> DataFrame:
    """O-01: multi-key mixed-direction sort."""
    return df.orderBy(*specs)


def top_k(df: DataFrame, specs: Sequence[Column], k: int = 200) -> DataFrame:
    """O-02: ORDER BY … LIMIT k (TakeOrderedAndProject: per-partition top-k, then merge)."""
    return df.orderBy(*specs).limit(k)


def top_k_distinct_per(df: DataFrame, req_key: Sequence[str], ts: str, k: int = 20) -> DataFrame:
    """O-03: the first ``k`` distinct ``ts`` values per request (``dense_rank() <= k``) over
    distinct (request, ts) pairs."""
    d = df.select(*req_key, ts).distinct()
    w = Window.partitionBy(*req_key).orderBy(ts)
    return d.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def first_n(df: DataFrame, key: Sequence[str], order: Sequence[Column], n_col: str) -> DataFrame:
    """O-04: first ``n`` rows per key, where ``n`` is a column."""
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col(n_col)).drop("_rn")


# ---- U: set operations -----------------------------------------------------------------

def union_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """U-02: set union (deduplicated)."""
    return a.unionByName(b).distinct()


def minus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """U-03: set difference of distinct sets."""
    return a.subtract(b)


def keep_members(df: DataFrame, ids: DataFrame, on: Sequence[str]) -> DataFrame:
    """U-04: rows whose key is in ``ids``."""
    return df.join(ids.select(*on).distinct(), list(on), "left_semi")


def airport_match(labels: DataFrame, queries: DataFrame, q_col: str = "q") -> DataFrame:
    """P-13: airports matching each query — code starts with the query or label contains it
    (case-insensitive, trimmed) — plus the query's resolved code: the exact code match, else
    the exact label match.

    The non-equi match is turned into an equi join on a substring index of the (small,
    bounded) airport dimension: every prefix of each code and every substring of each label.
    """
    lab = labels.select(F.col("Code"), F.col("Label"), F.upper("Code").alias("_uc"), F.upper("Label").alias("_ul"))
    pre = lab.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_uc")))) \
             .select("Code", F.substring("_uc", F.lit(1), F.col("_i")).alias("_key"))
    sub = (lab.withColumn("_i", F.explode(F.sequence(F.lit(1), F.length("_ul"))))
              .withColumn("_j", F.explode(F.sequence(F.col("_i"), F.length("_ul"))))
              .select("Code", F.substring("_ul", F.col("_i"), F.col("_j") - F.col("_i") + 1).alias("_key")))
    index = pre.unionByName(sub).distinct()
    q = queries.select(F.col(q_col).alias("q"), F.upper(F.trim(F.col(q_col))).alias("_key")).distinct()
    hits = q.join(index, "_key", "inner").join(lab.select("Code", "Label", "_uc", "_ul"), "Code")
    exact = hits.groupBy("q").agg(
        F.coalesce(F.min(F.when(F.col("_uc") == F.col("_key"), F.col("Code"))),
                   F.min(F.when(F.col("_ul") == F.col("_key"), F.col("Code")))).alias("resolved"))
    return hits.select("q", "Code", "Label").join(exact, "q", "left")
