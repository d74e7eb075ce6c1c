"""SparkSession construction with the settings every skyops plan assumes."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "skyops") -> SparkSession:
    """Return a session configured for skyops.

    * UTC session time zone: all instants are ``TIMESTAMP_NTZ`` wall-clock values and an
      explicit ``as_of`` is passed to operators, so the zone only matters for conversions.
    * AQE on (coalescing, skew join) so shuffle sizes adapt at runtime.
    * The Spark UI is disabled.
    * ``spark.checkpoint.dir`` is respected when the cluster sets it; only when it is
      unset (tests, local runs) a scratch directory is assigned.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    cpus = os.cpu_count() or 8
    b = (b.config("spark.sql.session.timeZone", "UTC")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus))
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master and master.startswith("local"):
        b = b.config("spark.driver.memory", os.environ.get("SKYOPS_DRIVER_MEMORY", "16g"))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint directory, assigning a scratch one only if unset."""
    try:
        cur = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # noqa: BLE001 - some deployments hide core confs from the SQL conf
        cur = None
    if not cur:
        cur = spark.sparkContext.getCheckpointDir()
        if cur:
            return cur
    if not cur:
        # unset: a scratch directory where driver and executors share the machine; a cluster has to name one
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        cur = tempfile.mkdtemp(prefix="skyops-ckpt-", dir=os.environ.get("SKYOPS_SCRATCH", "/tmp"))
        try:
            spark.conf.set("spark.checkpoint.dir", cur)
        except Exception:  # noqa: BLE001 - a core conf may be read-only at runtime
            pass
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(cur)
    return spark.sparkContext.getCheckpointDir() or cur


def cut_lineage(df):
    """Write ``df`` as a table in the shared checkpoint directory and return a frame reading it.

    Used where one intermediate feeds several branches of a deep plan; the table survives executor loss (never a local
    checkpoint), is computed once (a checkpoint runs its last stage twice) and read by columns."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
