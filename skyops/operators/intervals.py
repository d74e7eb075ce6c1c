"""Skew-safe temporal operators.

``next_event_after``
    For each point, the first event strictly after it with the same key (W-03, J-12, the
    "no departure in (arr, t]" tests of J-09). A plain ``Window.partitionBy(key)`` would put
    every row of a hot key (an aircraft or a crew member holding a third of all legs) into
    one task and sort it there. Instead the window runs per (key, time bucket) and the
    hand-off between buckets goes through a per-bucket minimum table whose size is
    keys × buckets, not rows.

``interval_point_join``
    Points ``(key, t)`` joined to intervals ``(key, [from, to))`` containing them (J-10, the
    aircraft and crew location tests of D-02/D-03). A join on ``key`` alone with a range
    residual compares every point with every interval of the key — quadratic for a hot
    airport. Here the time axis is cut into hour buckets, each interval is decomposed into at
    most two dyadic blocks per level (the canonical segment-tree cover of its bucket range)
    and each point is expanded into its one enclosing block per level. The join is then a
    pure equi join on ``(key, level, block)``: every (interval, point) pair whose buckets
    overlap meets exactly once, and only pairs that share a boundary hour need the exact
    residual ``from <= t < to``.

Neither operator uses synthetic row ids: results are keyed by the natural columns
(``keys`` + timestamp), so a recomputed partition after an executor loss joins back
identically.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyops.session import cut_lineage

# bucket origin; bucket indexes are hours since this instant
_BASE = "1900-01-01 00:00:00"
# 2^23 hours ≈ 957 years → buckets cover 1900 … 2856
LEVELS = 23
_MAX_BUCKET = (1 << LEVELS) - 1
# intervals of a cell that are packed together
PACKED = 1000


def _base() -> Column:
    return F.to_timestamp_ntz(F.lit(_BASE))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hour_bucket(ts) -> Column:
    b = F.timestamp_diff("HOUR", _base(), _col(ts))
    return F.least(F.greatest(b, F.lit(0).cast("long")), F.lit(_MAX_BUCKET).cast("long"))


def _micros(ts) -> Column:
    return F.timestamp_diff("MICROSECOND", _base(), _col(ts))


def next_event_after(points: DataFrame, events: DataFrame, keys: Sequence[str], point_ts: str,
                     event_ts: str, out: str, bucket: str = "DAY") -> DataFrame:
    """Add ``out`` = min(events.event_ts) with the same ``keys`` and ``event_ts > point_ts``
    (NULL when there is none) to every row of ``points``."""
    keys = list(keys)
    unit = {"DAY": "DAY", "HOUR": "HOUR"}[bucket]
    qp = points.select(*keys, F.col(point_ts).alias("_t")).distinct()
    pts = qp.select(*keys, "_t", F.lit(True).alias("_is_p"), F.lit(None).cast("timestamp_ntz").alias("_e"))
    evs = events.select(*keys, F.col(event_ts).alias("_t"), F.lit(False).alias("_is_p"),
                        F.col(event_ts).alias("_e"))
    u = (pts.unionByName(evs)
         .withColumn("_b", F.timestamp_diff(unit, _base(), F.col("_t")))
         .withColumn("_us", _micros("_t")))
    # 1) strictly later events inside the same (key, bucket)
    w_in = Window.partitionBy(*keys, "_b").orderBy("_us").rangeBetween(1, Window.unboundedFollowing)
    local = u.withColumn("_next_in", F.min("_e").over(w_in)).where("_is_p")
    # 2) first event of any later bucket, from the (key, bucket) minimum table
    bmin = u.groupBy(*keys, "_b").agg(F.min("_e").alias("_bmin"))
    w_b = Window.partitionBy(*keys).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    later = bmin.withColumn("_next_b", F.min("_bmin").over(w_b)).select(*keys, "_b", "_next_b")
    nxt = (local.join(later, keys + ["_b"], "left")
           .select(*keys, F.col("_t").alias(point_ts), F.coalesce("_next_in", "_next_b").alias(out)))
    return points.join(nxt, keys + [point_ts], "left")


def _explode_blocks(df: DataFrame) -> DataFrame:
    """Rows of ``df`` (with bucket range ``_lo``…``_hi``) × their canonical dyadic cover ``(_lvl, _k)``."""
    lv = df.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    a = F.expr("shiftright(_lo + (shiftleft(1L, _lvl) - 1), _lvl)")
    b = F.expr("shiftright(_hi + 1, _lvl) - 1")
    pa = F.expr("shiftright(_lo + (shiftleft(1L, _lvl + 1) - 1), _lvl + 1)")
    pb = F.expr("shiftright(_hi + 1, _lvl + 1) - 1")
    lv = lv.withColumn("_a", a).withColumn("_bb", b).withColumn("_pa", pa).withColumn("_pb", pb) \
           .where(F.col("_a") <= F.col("_bb"))
    top = F.col("_lvl") >= LEVELS
    ex = lv.withColumn("_k", F.explode(F.array_distinct(F.array("_a", "_bb"))))
    keep = top | (F.col("_pa") > F.col("_pb")) | (F.col("_k") < 2 * F.col("_pa")) | (F.col("_k") > 2 * F.col("_pb") + 1)
    return ex.where(keep).drop("_a", "_bb", "_pa", "_pb", "_lo", "_hi")


def interval_point_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_ts: str,
                        from_ts: str, to_ts: str, how: str = "inner") -> DataFrame:
    """Join each point to every interval with equal ``keys`` and ``from <= t < to``
    (``to`` NULL = open-ended). Apart from ``keys`` the column names of the two sides must
    be distinct.

    ``how='inner'`` returns the matched pairs; ``'left_semi'``/``'left_anti'`` keep the points
    that have / have no containing interval.
    """
    keys = list(keys)
    if how in ("left_semi", "left_anti"):
        # membership depends only on (keys, t): compute it for the distinct points
        qp = points.select(*keys, point_ts).distinct()
        hit = interval_point_join(qp, intervals.select(*keys, from_ts, to_ts), keys, point_ts, from_ts, to_ts)
        return points.join(hit.select(*keys, point_ts).distinct(), keys + [point_ts], how)
    if how != "inner":
        raise ValueError(how)
    iv = (intervals.withColumn("_lo", hour_bucket(from_ts))
          .withColumn("_hi", F.when(F.col(to_ts).isNull(), F.lit(_MAX_BUCKET).cast("long"))
                      .otherwise(hour_bucket(to_ts))))
    iv = _explode_blocks(iv)
    pt = (points.withColumn("_p", hour_bucket(point_ts))
          .withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
          .withColumn("_k", F.expr("shiftright(_p, _lvl)")).drop("_p"))
    j = pt.join(iv, keys + ["_lvl", "_k"], "inner")
    j = j.where((F.col(from_ts) <= F.col(point_ts)) & (F.col(to_ts).isNull() | (F.col(point_ts) < F.col(to_ts))))
    return j.drop("_lvl", "_k")


def interval_point_pairs(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_ts: str, from_ts: str, to_ts: str) -> DataFrame:
    """The pairs of :func:`interval_point_join`, formed by unpacking arrays, for where the pairs far outnumber both sides.

    The intervals of a cell (key, level, block) are packed into arrays of some ``PACKED`` of them, each with a number of its own; a point meets every
    array of its cells once, and its pairs are formed from it in place. So what is shuffled is points x arrays, a thousandth of the pairs, and a hot
    cell is spread by the numbers of its arrays. The shuffles are small and their output is not, so they keep a number of partitions of their own."""
    keys, cell = list(keys), [*keys, "_lvl", "_k"]
    spark = points.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    at = (points.select(*keys, point_ts).distinct().withColumn("_p", hour_bucket(point_ts))
          .select(*keys, F.col("_p"), F.explode(F.sequence(F.lit(0), F.lit(LEVELS))).alias("_lvl"))
          .select(*keys, "_lvl", F.expr("shiftright(_p, _lvl)").alias("_k")).distinct())
    iv = (intervals.withColumn("_lo", hour_bucket(from_ts))
          .withColumn("_hi", F.when(F.col(to_ts).isNull(), F.lit(_MAX_BUCKET).cast("long")).otherwise(hour_bucket(to_ts))))
    iv = cut_lineage(_explode_blocks(iv).join(at, cell, "left_semi"))
    arrays = cut_lineage(iv.groupBy(*cell).agg(F.ceil(F.count("*") / PACKED).cast("int").alias("_n")))
    payload = [c for c in intervals.columns if c not in keys]
    numbered = cut_lineage(iv.join(arrays, cell).withColumn("_a", F.pmod(F.xxhash64(*payload), F.col("_n")).cast("int")).drop("_n"))
    packed = (numbered.repartition(parts, *cell, "_a").groupBy(*cell, "_a").agg(F.collect_list(F.struct(*payload)).alias("_held")))
    asked = (cut_lineage(points.withColumn("_p", hour_bucket(point_ts)).withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
             .withColumn("_k", F.expr("shiftright(_p, _lvl)")).drop("_p").join(arrays, cell))
             .withColumn("_a", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n").repartition(parts, *cell, "_a"))
    pairs = asked.join(packed.hint("merge"), [*cell, "_a"]).select(*points.columns, F.inline("_held"))
    return pairs.where((F.col(from_ts) <= F.col(point_ts)) & (F.col(to_ts).isNull() | (F.col(point_ts) < F.col(to_ts))))


def next_k_distinct(points: DataFrame, events: DataFrame, keys: Sequence[str], point_ts: str,
                    event_ts: str, k: int, out: str) -> DataFrame:
    """For each point, the first ``k`` distinct ``event_ts`` values strictly after it (same
    ``keys``), one row per candidate (O-03).

    Distinct event times get a global rank per key from two levels of counting — a running
    count inside each (key, day) and the prefix sum of the per-(key, day) counts — so no
    task ever holds all events of a hot key. A point's candidates are then the ranks
    ``c+1 … c+k`` where ``c`` is the number of event times ``<= t``: an equi join on
    (key, rank) that emits at most ``k`` rows per point.
    """
    keys = list(keys)
    ev = events.select(*keys, F.col(event_ts).alias("_t")).distinct().withColumn("_is_e", F.lit(1))
    pts = points.select(*keys, F.col(point_ts).alias("_t")).distinct().withColumn("_is_e", F.lit(0))
    u = ev.unionByName(pts).withColumn("_b", F.timestamp_diff("DAY", _base(), F.col("_t")))
    w = (Window.partitionBy(*keys, "_b").orderBy(F.col("_t"), F.desc("_is_e"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    u = u.withColumn("_loc", F.sum("_is_e").over(w))
    per_b = u.groupBy(*keys, "_b").agg(F.sum("_is_e").alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = per_b.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0))).select(*keys, "_b", "_off")
    ranked = u.join(off, keys + ["_b"], "inner").withColumn("_g", F.col("_off") + F.col("_loc"))
    ev_r = ranked.where("_is_e = 1").select(*keys, F.col("_g").alias("_r"), F.col("_t").alias(out))
    pt_r = (ranked.where("_is_e = 0")
            .select(*keys, F.col("_t").alias(point_ts),
                    F.explode(F.sequence(F.col("_g") + 1, F.col("_g") + k)).alias("_r")))
    cand = pt_r.join(ev_r, keys + ["_r"], "inner").drop("_r")
    return points.join(cand, keys + [point_ts], "inner")


def count_covering(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point_ts: str, from_ts: str,
                   to_ts: str, out: str) -> DataFrame:
    """For each distinct point ``(keys, t)``, the number of intervals ``[from, to)`` with equal
    ``keys`` that contain ``t`` — without forming (point, interval) pairs.

    covering(t) = #starts <= t − #ends <= t. Starts (+1) and ends (−1) are merged with the
    points and summed by a running window inside each (key, day) plus the prefix sum of the
    per-(key, day) totals, so a hot key never lands in one task and the work is linear in
    points + intervals. → ``(keys, point_ts, out)``
    """
    keys = list(keys)
    # empty intervals (to <= from) contain nothing; dropping them keeps starts and ends paired
    intervals = intervals.where(F.col(to_ts).isNull() | (F.col(to_ts) > F.col(from_ts)))
    starts = intervals.select(*keys, F.col(from_ts).alias("_t"), F.lit(1).alias("_d"))
    ends = intervals.where(F.col(to_ts).isNotNull()).select(*keys, F.col(to_ts).alias("_t"), F.lit(-1).alias("_d"))
    ev = starts.unionByName(ends).withColumn("_is_p", F.lit(False))
    pts = points.select(*keys, F.col(point_ts).alias("_t")).distinct().withColumn("_d", F.lit(0)) \
                .withColumn("_is_p", F.lit(True))
    u = ev.unionByName(pts).withColumn("_b", F.timestamp_diff("DAY", _base(), F.col("_t")))
    # events at the same instant as a point are counted before it (starts cover, ends do not)
    w = (Window.partitionBy(*keys, "_b").orderBy(F.col("_t"), F.col("_is_p"))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = u.withColumn("_loc", F.sum("_d").over(w)).where("_is_p")
    per_b = u.groupBy(*keys, "_b").agg(F.sum("_d").alias("_n"))
    wb = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = per_b.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0))).select(*keys, "_b", "_off")
    return (local.join(off, keys + ["_b"], "inner")
            .select(*keys, F.col("_t").alias(point_ts), (F.col("_off") + F.col("_loc")).cast("long").alias(out)))


def carry_scan(events: DataFrame, keys: Sequence[str], ts: str, sums: Sequence[str] = (), lasts: Sequence[str] = (),
               lead: str | None = None) -> DataFrame:
    """A scan of each key's events in time order, without a window over a key's rows.

    ``events`` has one row per (keys, ts) at most, so a (key, day) holds no more rows than a day has instants, however many
    rows a hot key came from. Each column of ``sums`` becomes its running total up to and with the row, each of ``lasts`` its
    last value so far that is not NULL; ``lead`` names a new column, the next row's instant. What one day hands to the
    next goes through a table with a row per (key, day).
    """
    keys = list(keys)
    e = events.withColumn("_b", F.timestamp_diff("DAY", _base(), F.col(ts)))
    w = Window.partitionBy(*keys, "_b").orderBy(ts)
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = e.select(*[c for c in e.columns if c not in {*sums, *lasts}], *[F.sum(c).over(so_far).alias(c) for c in sums],
                     *[F.last(c, ignorenulls=True).over(so_far).alias(c) for c in lasts], *([F.lead(ts).over(w).alias(lead)] if lead else []))
    days = e.groupBy(*keys, "_b").agg(F.min(ts).alias("_first"), *[F.sum(c).alias(f"_{c}") for c in sums],
                                      *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(ts))).alias(f"_{c}") for c in lasts])
    wd = Window.partitionBy(*keys).orderBy("_b")
    before = wd.rowsBetween(Window.unboundedPreceding, -1)
    carried = days.select(*keys, "_b", *[F.sum(f"_{c}").over(before).alias(f"_{c}") for c in sums],
                          *[F.last(f"_{c}", ignorenulls=True).over(before).alias(f"_{c}") for c in lasts], F.lead("_first").over(wd).alias("_next"))
    j = local.join(carried, [*keys, "_b"])
    j = j.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in sums} | {c: F.coalesce(c, f"_{c}") for c in lasts}
                      | ({lead: F.coalesce(lead, "_next")} if lead else {}))
    return j.drop("_b", "_next", *[f"_{c}" for c in (*sums, *lasts)])


def rank_cover(ranges: DataFrame, lo: str, hi: str) -> DataFrame:
    """Rows × the canonical dyadic blocks ``(_lvl, _k)`` of the ranks ``lo <= r < hi``: at most two a level, and only levels that the
    range's length reaches. Block k of level l holds the ranks k * 2^l to (k + 1) * 2^l - 1. Empty ranges give no rows."""
    lv = ranges.where(F.col(lo) < F.col(hi)).withColumn("_lvl", F.expr(f"explode(sequence(0, length(bin({hi} - {lo})) - 1))"))
    # whole blocks of a level inside the range, and of the level above
    lv = (lv.withColumn("_a", F.expr(f"shiftright({lo} + shiftleft(1L, _lvl) - 1, _lvl)")).withColumn("_e", F.expr(f"shiftright({hi}, _lvl)"))
          .withColumn("_pa", F.expr(f"2 * shiftright({lo} + shiftleft(2L, _lvl) - 1, _lvl + 1)")).withColumn("_pe", F.expr(f"2 * shiftright({hi}, _lvl + 1)")))
    ex = lv.where("_a < _e").withColumn("_k", F.explode(F.array_distinct(F.expr("array(_a, _e - 1)"))))
    return ex.where("_pa >= _pe OR _k < _pa OR _k >= _pe").drop("_a", "_e", "_pa", "_pe")


def enclosing_blocks(ranks: DataFrame, rank: str, most: Column) -> DataFrame:
    """Rows × the blocks ``(_lvl, _k)`` that hold their rank, for all levels a range of ``most`` ranks can reach."""
    return (ranks.withColumn("_lvl", F.explode(F.sequence(F.lit(0), F.length(F.bin(most)) - 1)))
            .withColumn("_k", F.expr(f"shiftright({rank}, _lvl)")))


def events_between(pairs: DataFrame, events: DataFrame, keys: Sequence[str], lo: str, hi: str, event_ts: str, out: str) -> DataFrame:
    """(keys, lo, hi, out) for the distinct pairs of instants of ``pairs`` (``hi`` not NULL): how many distinct events with equal ``keys`` lie
    in ``(lo, hi]``, as a difference of running counts."""
    key = [*keys, "_one"]  # never an empty key
    pairs = pairs.where(F.col(hi).isNotNull()).select(*keys, lo, hi).distinct()
    points = pairs.select(*keys, F.explode(F.array(lo, hi)).alias("_at")).distinct().withColumn("_one", F.lit(0))
    since = events.select(*keys, F.lit(0).alias("_one"), F.col(event_ts).alias("_from")).distinct().withColumn("_to", F.lit(None).cast("timestamp_ntz"))
    upto = count_covering(points, since, key, "_at", "_from", "_to", "_n").drop("_one")
    both = pairs.join(upto.select(*keys, F.col("_at").alias(lo), F.col("_n").alias("_n0")), [*keys, lo]).join(
        upto.select(*keys, F.col("_at").alias(hi), F.col("_n").alias("_n1")), [*keys, hi])
    return both.select(*keys, lo, hi, (F.col("_n1") - F.col("_n0")).alias(out))
