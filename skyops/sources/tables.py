"""Sources and sinks (S-01 … S-11): explicit-schema reads, JDBC option building, bulk load,
append, insert-or-ignore, upsert, conditional update, text and JSON sinks.

Every writer is copy-on-write: it writes a new path (or appends), never overwrites the
input it is reading.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyops.schema import SCHEMAS


# S-01
def read_table(spark: SparkSession, directory: str, name: str, fmt: str = "parquet") -> DataFrame:
    """Scan one airline table with its declared schema (column pruning and filter pushdown
    happen in the scan)."""
    return spark.read.schema(SCHEMAS[name]).format(fmt).load(os.path.join(directory, name))


# S-02
def jdbc_options(url: str, table: str, partition_column: str | None = None, lower: int | None = None,
                 upper: int | None = None, num_partitions: int | None = None, **extra) -> dict[str, str]:
    """Options for ``spark.read.format('jdbc')``; with bounds the read is split into
    ``num_partitions`` range queries on ``partition_column`` (parallel reads)."""
    opts = {"url": url, "dbtable": table}
    if partition_column is not None:
        if lower is None or upper is None or not num_partitions:
            raise ValueError("partitioned JDBC reads need lower, upper and num_partitions")
        opts.update(partitionColumn=partition_column, lowerBound=str(lower), upperBound=str(upper),
                    numPartitions=str(num_partitions))
    opts.update({k: str(v) for k, v in extra.items()})
    return opts


def read_jdbc(spark: SparkSession, url: str, table: str, **bounds) -> DataFrame:
    """S-02: a database table over JDBC (the driver jar must be on the classpath)."""
    return spark.read.format("jdbc").options(**jdbc_options(url, table, **bounds)).load()


# S-03
def run_sql(spark: SparkSession, sql: str, args: dict | None = None) -> DataFrame:
    """Parameterised SQL with named markers (``:name``) bound by Spark, over temp views."""
    return spark.sql(sql, args=args or {})


# S-05
def load(spark: SparkSession, src: str, fmt: str, name: str, mode: str = "FAILFAST", **options) -> DataFrame:
    """Read a seed file of table ``name`` with its declared schema; the default ``FAILFAST``
    stops at the first malformed row (as the reference's seed loader)."""
    r = spark.read.schema(SCHEMAS[name]).option("mode", mode)
    for k, v in options.items():
        r = r.option(k, v)
    return r.format(fmt).load(src)


# S-06
def append(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append rows to a table directory."""
    df.write.mode("append").format(fmt).save(path)


# S-07
def first_per_key(new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the smallest by ``order``, then by the other columns, so a retry picks the same row."""
    rest = [c for c in new.columns if c not in keys]
    by = [c for c in order if c in rest] + [c for c in rest if c not in order]
    if not by:
        return new.distinct()
    return new.groupBy(*keys).agg(F.min(F.struct(*by)).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def insert_ignore(target: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """``INSERT OR IGNORE``: new rows whose key is absent from ``target`` are added; of several new rows of
    one key the first by ``order``."""
    fresh = first_per_key(new, keys, order).join(target.select(*keys), list(keys), "left_anti")
    return target.unionByName(fresh.select(*target.columns))


# S-08
def upsert(target: DataFrame, new: DataFrame, keys: Sequence[str], cols: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Update ``cols`` of existing keys from ``new`` (NULLs are written too); insert the other new rows. Of
    several new rows of one key the first by ``order`` counts."""
    n = first_per_key(new, keys, order).select(*keys, *[F.col(c).alias(f"_new_{c}") for c in cols], F.lit(True).alias("_hit"))
    j = target.join(n, list(keys), "full_outer")
    return j.select(*keys, *[F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
                             for c in target.columns if c not in keys])


# S-09
def update_where(df: DataFrame, pred: Column, assignments: dict[str, Column | object]) -> DataFrame:
    """``UPDATE … SET col = v … WHERE pred`` as one projection: predicate and values read the row as it was."""
    new = {c: v if isinstance(v, Column) else F.lit(v) for c, v in assignments.items()}
    return df.select(*[F.when(pred, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns])


# S-10
def write_summary(summary: DataFrame, path: str) -> None:
    """Write one-row executive summaries (a single string column) as text files."""
    col = summary.columns[0]
    summary.select(F.col(col).cast("string").alias("value")).write.mode("overwrite").text(path)


def revenue_summary_text(summary: DataFrame) -> DataFrame:
    """Text of the revenue executive summary from :func:`skyops.plans.reports.revenue_summary`."""
    return summary.select(F.format_string(
        "Total revenue: $%s | Most profitable category: %s %s (%s) with $%s | Top manufacturer: %s ($%s)",
        F.format_number("Total_Revenue", 2), "Top_Manufacturer_Row", "Top_Size", "Top_Class",
        F.format_number("Top_Income", 2), "Top_Manufacturer", F.format_number("Top_Manufacturer_Income", 2))
        .alias("value"))


def cancellation_summary_text(rates: DataFrame, limit: float = 10.0) -> DataFrame:
    """Text of the cancellation executive summary from monthly rates ``(Month, Cancellation_Rate)``: the
    average, the worst month (ties: the first), the months above ``limit`` per cent, and what follows from it."""
    high = F.col("Cancellation_Rate") > limit
    s = rates.agg(F.avg("Cancellation_Rate").alias("mean"), F.min(F.struct((-F.col("Cancellation_Rate")).alias("r"), F.col("Month").alias("m"))).alias("top"),
                  F.array_join(F.array_sort(F.collect_list(F.when(high, F.col("Month")))), ", ").alias("months"))  # one row per month
    advice = F.when(-F.col("top.r") > limit, F.concat(F.lit("look into the cancellations of "), F.col("top.m"))).otherwise(F.lit("rates look stable"))
    return s.select(F.concat(
        F.lit("Average cancellation rate: "), F.format_number("mean", 2), F.lit("% | Peak month: "), F.col("top.m"), F.lit(" with "), F.format_number(-F.col("top.r"), 2),
        F.lit("% | Months above "), F.lit(str(int(limit))), F.lit("%: "), F.when(F.col("months") == "", F.lit("none")).otherwise(F.col("months")),
        F.lit(" | Conclusion: "), advice).alias("value"))


# S-11
def to_json_rows(df: DataFrame, cols: Sequence[str], out: str = "json") -> DataFrame:
    """One JSON object per row with ``cols`` (e.g. ``{"code":…,"label":…}``)."""
    return df.select(F.to_json(F.struct(*cols)).alias(out))


__all__ = ["read_table", "jdbc_options", "read_jdbc", "run_sql", "load", "append", "insert_ignore", "upsert",
           "update_where", "write_summary", "revenue_summary_text", "to_json_rows"]
