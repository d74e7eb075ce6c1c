"""T-02: seat admission over a stream of booking requests, with the seats as keyed state.

Requests arrive as files. Each micro-batch keeps the requests whose seat can be sold (the ticket exists and is available, no Active link holds it; a
stream-static join) and folds them into one state row per seat: the first request by (batch, request_ts, order_id). The batch is known by its timestamp,
which Spark logs with the batch's offsets, so a replayed batch folds in the same rows with the same instant. A seat's winner therefore never changes once its
batch is over, a request that comes in a later file than the winner loses whatever its own instant, and a seat is never forgotten (no watermark: the state
holds at most one row per seat ever asked for). When requests arrive in order, the accepted set equals the batch operator on the whole input.

A batch emits the seats it touched and writes those won in it to ``<out>/batch=<id>``, replacing what an interrupted attempt left there. It reads no earlier batch.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyops.operators.booking import SEAT4, active_links

REQUEST_SCHEMA = T.StructType([
    T.StructField("request_ts", T.TimestampNTZType(), False),
    T.StructField("order_id", T.LongType(), False),
    T.StructField("email", T.StringType(), True),
    T.StructField("Flight_ID", T.StringType(), False),
    T.StructField("CLASS_Type", T.StringType(), False),
    T.StructField("SEAT_Row_num", T.IntegerType(), False),
    T.StructField("SEAT_Column_number", T.StringType(), False),
])
#: what a seat's state keeps of its winner, in the order that decides
_WINNER = ["request_ts", "order_id", "email", "Airplane_ID", "Price"]


def sellable_requests(requests: DataFrame, tables) -> DataFrame:
    """Requests for seats that exist, are available and have no Active link, with the ticket's aircraft and price."""
    sold = tables.ticket.where("Availability = 1").select(*SEAT4, "Airplane_ID", "Price")
    return requests.join(sold, SEAT4).join(active_links(tables).select(*SEAT4), SEAT4, "left_anti")


def seat_winners(requests: DataFrame, tables) -> DataFrame:
    """SEAT4, ``first`` (batch instant and winner), ``touched`` (instant of the latest batch that asked for the seat): the state of the stream."""
    r = sellable_requests(requests, tables).withColumn("batch_ts", F.current_timestamp())
    return r.groupBy(*SEAT4).agg(F.min(F.struct("batch_ts", *_WINNER)).alias("first"), F.max("batch_ts").alias("touched"))


def stream_seat_admission(spark, requests_dir: str, tables, out: str, checkpoint: str,
                          trigger: dict | None = None, max_files_per_trigger: int | None = None):
    reader = spark.readStream.schema(REQUEST_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    winners = seat_winners(reader.parquet(requests_dir), tables)

    def batch(df: DataFrame, batch_id: int) -> None:
        won = df.where(F.col("first.batch_ts") == F.col("touched")).select(*SEAT4, *[f"first.{c}" for c in _WINNER])
        (won.select(*REQUEST_SCHEMA.fieldNames(), "Airplane_ID", "Price", F.lit(batch_id).cast("long").alias("batch_id"))
         .write.mode("overwrite").parquet(os.path.join(out, f"batch={batch_id}")))

    w = winners.writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"processingTime": "10 seconds"}))
    return w.start()
