"""Sharding by a consistent-hash ring with virtual nodes and bounded loads.

The ring has ``CELLS`` cells. A shard stands on it with ``nodes`` virtual nodes, each in the cell its hash names; a row's key names a cell, and the row's home
is the shard of the next virtual node clockwise. No shard holds more than its bound: rows that come to a full shard continue clockwise to the
next one that has room. Which rows a shard takes when more come than it has room for is decided by a hash of the row (key and
content), so the outcome does not depend on partitioning. With ``slack`` 0 the bounds add up to the number of rows, so all
shards end exactly at them and row counts are at most one apart; a larger slack moves fewer rows when shards are added.

It runs in rounds over all rows at once. In each, every row still without a shard goes to the first shard clockwise with room. Counts per (shard, top bits of the
row hash) tell which shards overflow and, by counting further bits, the last row each can take; it takes the rows up to that one, and the others (a
few in a hundred, staged as a table that shrinks) go round again. A shard that overflows is full afterwards, so there are at most as many rounds as shards;
no count has more than 256 groups a shard, the routes are one broadcast table of CELLS rows, and no key's rows meet in one task:
a key with a third of all rows fills its home, then the shards after it.

Slots count a shard's rows from 0 in the order of the row hash: rows are range-partitioned by (shard, hash), and a row's slot is its place in its
partition plus the rows of its shard in earlier ones.

Defined results: null keys are one key; equal rows are interchangeable and get slots of their own; null texts and sizes are kept as they are; an
empty table gives an empty table; all other columns pass through, whatever their names, except that columns named shard or slot raise ValueError.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skyops.llm.common import stage, unused

CELLS = 1 << 16
#: bits counted at once, and rows of a shard among which the last one it takes is looked up directly
BITS, DIRECT = 8, 1024


def ring(shards: int, nodes: int = 512) -> list[tuple[int, int]]:
    """(hash, shard) of all virtual nodes, clockwise. A shard's nodes do not depend on how many shards there are."""
    return sorted((int.from_bytes(hashlib.sha256(f"{s}/{v}".encode()).digest()[:8], "big"), s) for s in range(shards) for v in range(nodes))


def routes(points: list[tuple[int, int]], full: set[int]) -> np.ndarray:
    """For each cell the first shard clockwise that is not in ``full``."""
    left = [(h * CELLS >> 64, s) for h, s in points if s not in full]
    at, shard = np.array([c for c, _ in left]), np.array([s for _, s in left], np.int32)
    return shard[np.searchsorted(at, np.arange(CELLS)) % len(shard)]


def _last_taken(rows: DataFrame, shard: str, turn: str, row: str, first: dict[int, dict[int, int]], room: dict[int, int]) -> dict[int, tuple[int, int]]:
    """The (turn, row) of the ``room[s]``-th row of each shard ``s`` in that order. ``first``: counts by the top bits of the turn."""
    done: dict[int, tuple[int, int]] = {}
    rest, high = dict(room), {s: 0 for s in room}
    found, column, known = first, turn, {}  # known: shards whose turn is settled; their equal rows are told apart by row number
    shift = 64 - BITS
    while True:
        size = {}
        for s in rest:
            for b in sorted(found[s]):
                high[s], size[s] = b, found[s][b]
                if found[s][b] >= rest[s]:
                    break
                rest[s] -= found[s][b]
        direct = F.lit(False)
        deeper = F.lit(False)
        small = [s for s in rest if size[s] <= DIRECT]
        large = [s for s in rest if size[s] > DIRECT]
        for s in rest:
            here = (F.col(shard) == s) & (F.shiftright(column, shift) == high[s])
            if column == row:
                here &= F.col(turn) == known[s]
            direct, deeper = (direct | here, deeper) if s in small else (direct, deeper | here)
        if small:
            each: dict[int, list[tuple[int, int]]] = {s: [] for s in small}
            for s, t, r in rows.where(direct).select(shard, turn, row).collect():  # at most DIRECT rows a shard
                each[s].append((t, r))
            for s in small:
                done[s] = sorted(each[s])[rest.pop(s) - 1]
        if not large:
            return done
        if shift == 0:  # more than DIRECT rows of one turn: equal rows, told apart by their numbers
            known, column, shift = dict(high), row, 64
            here = F.lit(False)
            for s in large:
                here |= (F.col(shard) == s) & (F.col(turn) == known[s])
            deeper = here
        shift -= BITS
        found = {s: {} for s in large}
        for s, b, n in rows.where(deeper).groupBy(shard, F.shiftright(column, shift)).count().collect():
            found[s][b] = n


def assign_shards(rows: DataFrame, shards: int, key: str = "doc_id", nodes: int = 512, slack: float = 0.0) -> DataFrame:
    """``rows`` with shard (0 to ``shards`` - 1) and slot. Bounds are ``(1 + slack) * rows / shards``, at least rows / shards rounded
    down, and rounded up for as many of the first shards as it takes."""
    if clash := {"shard", "slot"} & {c.lower() for c in rows.columns}:
        raise ValueError(f"columns {sorted(clash)} are made here")
    spark, columns = rows.sparkSession, [f"`{c}`" for c in rows.columns]
    cell, turn, row, part = unused(rows, "_cell", "_turn", "_row", "_part")
    k = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("null key"))
    pending = stage(rows.select("*", F.pmod(F.xxhash64(k, F.lit(1)), F.lit(CELLS)).cast("int").alias(cell),
                                F.xxhash64(k, *columns, F.lit(2)).alias(turn), F.monotonically_increasing_id().alias(row)), "shard-rows")
    total, points = pending.count(), ring(shards, nodes)
    room = {s: max(int((1 + slack) * total / shards), total // shards + (s < total % shards)) for s in range(shards)}
    placed: list[DataFrame] = []
    while True:
        full = {s for s, n in room.items() if n == 0}
        if len(full) == shards:  # no rows are left
            placed.append(pending.limit(0).withColumn("shard", F.lit(0)))
            break
        routed = pending.join(F.broadcast(_route_table(spark, routes(points, full), cell)), cell)
        counts: dict[int, dict[int, int]] = {}
        for s, b, n in routed.groupBy("shard", F.shiftright(turn, 64 - BITS)).count().collect():  # at most 256 rows a shard
            counts.setdefault(s, {})[b] = n
        arrived = {s: sum(c.values()) for s, c in counts.items()}
        over = {s: room[s] for s, n in arrived.items() if n > room[s]}
        if not over:
            placed.append(routed)
            break
        last = _last_taken(routed, "shard", turn, row, counts, over)
        refused = F.lit(False)
        for s, (t, r) in last.items():
            refused |= (F.col("shard") == s) & ((F.col(turn) > t) | ((F.col(turn) == t) & (F.col(row) > r)))
        placed.append(routed.where(~refused))
        pending = stage(routed.where(refused).drop("shard"), "shard-overflow")
        room = {s: n - min(n, arrived.get(s, 0)) for s, n in room.items()}
    every = placed[0].select(*columns, turn, row, "shard")
    for more in placed[1:]:
        every = every.unionByName(more.select(*columns, turn, row, "shard"))
    return _with_slots(every, columns, turn, row, part)


def _route_table(spark: SparkSession, shard: np.ndarray, cell: str) -> DataFrame:
    """CELLS rows: cell, shard."""
    import pandas as pd
    return spark.createDataFrame(pd.DataFrame({cell: np.arange(CELLS, dtype=np.int32), "shard": shard}), f"{cell} int, shard int")


def _with_slots(every: DataFrame, columns: list[str], turn: str, row: str, part: str) -> DataFrame:
    """Numbers the rows of each shard from 0 in the order of (turn, row)."""
    ordered = every.repartitionByRange("shard", turn, row).sortWithinPartitions("shard", turn, row)
    # an increasing number whose upper bits are the partition; it is written, so it stays what it is
    numbered = stage(ordered.select(*columns, "shard", F.monotonically_increasing_id().alias(row)), "shard-slots")
    in_part = F.shiftright(row, 33).alias(part)
    parts = numbered.groupBy("shard", in_part).agg(F.min(row).alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition of the shard
    starts = parts.select("shard", part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("slot"))
    return (numbered.withColumn(part, in_part).join(F.broadcast(starts), ["shard", part])
            .select(*columns, "shard", (F.col(row) + F.col("slot")).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int, **options) -> None:
    """Write the rows of ``docs`` with their slots as one folder of Parquet files a shard, sorted by slot within each file."""
    assigned = assign_shards(docs, shards, **options)
    assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

