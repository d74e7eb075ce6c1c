"""T-01: the periodic status refresh as a Structured Streaming job with a change log.

A stream of *ticks* (rows with an ``as_of`` instant, e.g. one file per 5 minutes) drives the rules of
:func:`skyops.operators.booking.status_refresh`. A micro-batch does not rewrite the tables: it writes the ids of the flights and orders that its
latest tick completes, ``<out>/v=<batch_id>/{flight,booking}``, out of the flights that departed since the tick before. The stored flights are
sorted by departure, so a tick reads the files of that span alone, and the links of those flights.

Readers merge on read (:func:`current`): a change is final, so the log holds ids alone and its order does not matter. :func:`compact` folds the
log into one version; the stream does so every ``COMPACT_EVERY`` ticks. A batch id whose version is complete is skipped when it is replayed, and an incomplete one is
written again, so the sink is idempotent. A tick that is not later than the last one changes nothing.
"""

from __future__ import annotations

import datetime as dt
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyops.operators.booking import OPEN
from skyops.sources import fs

TICK_SCHEMA = T.StructType([T.StructField("as_of", T.TimestampNTZType(), False)])
REFRESH_INTERVAL = "300 seconds"   # fixed: minimum period between refreshes
COMPACT_EVERY = 100                # ticks between two foldings of the log
LOGS = ("flight", "booking")


def _versions(spark: SparkSession, out: str, kind: str = "v") -> list[int]:
    return sorted(int(d.split("=", 1)[1]) for d in fs.list_dirs(spark, out)
                  if d.startswith(f"{kind}=") and fs.exists(spark, os.path.join(out, d, "_DONE")))


def _log_paths(spark: SparkSession, out: str, name: str, before: int | None = None) -> list[str]:
    """The newest folded version and the versions after it, up to the batch ``before`` (not with it)."""
    folded = [v for v in _versions(spark, out, "folded") if before is None or v < before]
    since = folded[-1] if folded else -1
    own = [v for v in _versions(spark, out) if v > since and (before is None or v < before)]
    return [os.path.join(out, f"folded={since}", name)] * bool(folded) + [os.path.join(out, f"v={v}", name) for v in own]


def changed_ids(spark: SparkSession, out: str, name: str, like: DataFrame) -> DataFrame:
    """Distinct ids of ``name`` that the log has completed."""
    ids = like.select("ID")
    paths = _log_paths(spark, out, name)
    return (spark.read.schema(ids.schema).parquet(*paths) if paths else ids.limit(0)).distinct()


def current(spark: SparkSession, out: str, tables) -> tuple[DataFrame, DataFrame]:
    """``flight`` and ``booking`` as of the last tick: the stored tables with the log merged in."""
    merged = []
    for name in LOGS:
        base = getattr(tables, name)
        done = changed_ids(spark, out, name, base).withColumn("_done", F.lit(True))
        merged.append(base.join(done, "ID", "left").withColumn("Status", F.when(F.col("_done"), "Completed").otherwise(F.col("Status")))
                      .select(*base.columns))
    return merged[0], merged[1]


def tick_changes(tables, since: Column | None, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Ids of the open flights, and of the Active orders with a ticket on any flight, that departed in ``(since, as_of]``."""
    gone = tables.flight.where(F.col("dep_ts") <= as_of)
    if since is not None:
        gone = gone.where(F.col("dep_ts") > since)
    links = tables.ticket_order.join(gone.select(F.col("ID").alias("Flight_ID")), "Flight_ID", "left_semi").select(F.col("Order_ID").alias("ID"))
    orders = tables.booking.where("Status = 'Active'").select("ID").join(links, "ID", "left_semi")
    return gone.where(F.col("Status").isin(*OPEN)).select("ID"), orders


def _last_tick(spark: SparkSession, out: str, before: int) -> dt.datetime | None:
    paths = _log_paths(spark, out, "tick", before)
    return spark.read.schema(TICK_SCHEMA).parquet(*paths).agg(F.max("as_of")).first()[0] if paths else None


def apply_tick(spark: SparkSession, tables, out: str, batch_id: int, as_of: dt.datetime | None) -> None:
    """Write the changes of one tick as version ``batch_id``."""
    target = os.path.join(out, f"v={batch_id}")
    if as_of is None or fs.exists(spark, os.path.join(target, "_DONE")):
        return  # no tick, or a replayed batch: already applied
    since = _last_tick(spark, out, batch_id)
    instant = max(as_of, since) if since else as_of
    changes = tick_changes(tables, F.lit(since).cast("timestamp_ntz") if since else None, F.lit(instant).cast("timestamp_ntz"))
    for name, df in zip(LOGS, changes, strict=True):
        df.write.mode("overwrite").parquet(os.path.join(target, name))
    spark.createDataFrame([(instant,)], TICK_SCHEMA).write.mode("overwrite").parquet(os.path.join(target, "tick"))
    fs.touch(spark, os.path.join(target, "_DONE"))


def compact(spark: SparkSession, tables, out: str) -> None:
    """Fold the log up to its last version into one version of distinct ids; readers of the old ones are not disturbed."""
    versions = _versions(spark, out)
    if not versions or versions[-1] in _versions(spark, out, "folded"):
        return
    target = os.path.join(out, f"folded={versions[-1]}")
    for name in LOGS:
        changed_ids(spark, out, name, getattr(tables, name)).write.mode("overwrite").parquet(os.path.join(target, name))
    spark.createDataFrame([(_last_tick(spark, out, versions[-1] + 1),)], TICK_SCHEMA).write.mode("overwrite").parquet(os.path.join(target, "tick"))
    fs.touch(spark, os.path.join(target, "_DONE"))


def stream_status_refresh(spark: SparkSession, ticks_dir: str, tables, out: str, checkpoint: str,
                          trigger: dict | None = None, compact_every: int = COMPACT_EVERY, max_files_per_trigger: int | None = None):
    """Start the refresh stream; ``tables`` is the stored :class:`~skyops.sources.airline.Airline`.
    ``trigger`` defaults to one micro-batch every 300 s; tests pass ``{"availableNow": True}``."""
    reader = spark.readStream.schema(TICK_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)

    def batch(df: DataFrame, batch_id: int) -> None:
        apply_tick(spark, tables, out, batch_id, df.agg(F.max("as_of")).first()[0])
        if (batch_id + 1) % compact_every == 0:
            compact(spark, tables, out)

    w = reader.parquet(ticks_dir).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": REFRESH_INTERVAL}))
    return w.start()
