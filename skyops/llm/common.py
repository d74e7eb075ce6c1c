"""Helpers of this package: shared scratch tables, table reads, slices of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skyops.session import ensure_checkpoint_dir

#: bytes of text handled at once inside a task (a longer document is handled alone)
SLICE_BYTES = 1 << 20


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder the session names in ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back (cuts lineage)."""
    path, schema = scratch(df.sparkSession, name), df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Texts are long: unless the session says otherwise, Arrow batches hold 1,000 rows instead of 10,000, which bounds what a task and its
    Python worker hold at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, "1000")


def texts(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` (and ``columns``) with the text as bytes, null text empty. Other columns stay behind, so
    extra or clashing names in ``docs`` do no harm."""
    small_batches(docs.sparkSession)
    return docs.select("doc_id", *columns, F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("text"))


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names``, lengthened until no column of ``df`` has them."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name in taken:
            name += "_"
        out.append(name)
    return out


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column, and n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset: column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0]: off[-1]], off - off[0]


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of at most ``limit`` bytes, or of one longer row."""
    data, off = flat(column)
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j, data[off[i]: off[j]], off[i: j + 1] - off[i]
        i = j
