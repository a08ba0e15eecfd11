"""Sinks: eval table, training shards, metrics log.

Writes are whole-job overwrites or appends of new files, so a retried task or
a lost executor never leaves half a table behind (the commit protocol only
publishes finished task output).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_eval(df: DataFrame, path: str) -> None:
    """Materialise the eval rows as a parquet table."""
    df.write.mode("overwrite").parquet(path)


def write_shards(df: DataFrame, path: str, n_shards: int, order: str = "k") -> None:
    """Hand-over to a trainer: ``n_shards`` files, each a contiguous
    range of ``order`` and sorted within, so shard i holds rows before shard
    i+1. Range bounds come from a sample; the order inside is exact."""
    df.repartitionByRange(n_shards, order).sortWithinPartitions(order) \
      .write.mode("overwrite").parquet(path)


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Append (run_id, step, metric, value) rows to the metrics table."""
    cols = ["run_id", "step", "metric", "value"]
    metrics.select(F.col("run_id").cast("string"), F.col("step").cast("bigint"),
                   F.col("metric").cast("string"), F.col("value").cast("double")).toDF(*cols) \
        .write.mode("append").partitionBy("metric").parquet(path)


def put_metrics(metrics: DataFrame, path: str, write_id: str) -> None:
    """S11, repeatable: the rows of one write, in partitions (metric, write_id) of their own.

    A job that runs again under the same ``write_id`` replaces what it wrote before, so nothing is counted twice; other
    writes stay. Equal (run_id, step, metric) within a write are one row, the one of greatest value."""
    rows = metrics.select(F.col("run_id").cast("string"), F.col("step").cast("bigint"), F.col("metric").cast("string"),
                          F.col("value").cast("double")) \
        .groupBy("run_id", "step", "metric").agg(F.max("value").alias("value")).withColumn("write_id", F.lit(write_id))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric", "write_id").parquet(path)
