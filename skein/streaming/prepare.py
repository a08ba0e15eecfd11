"""Incremental corpus preparation with Structured Streaming.

The reference's "streaming" is lazy iteration over files. Here a file source
feeds micro-batches and each micro-batch runs the same batch operators. A
vocabulary join contains an aggregation, so preparation runs in
``foreachBatch``; each batch overwrites its own ``batch_id=N`` directory, so
a replayed batch (at-least-once delivery) rewrites the same output instead of
duplicating it. Checkpoints live under the shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from skein.functions.hashing import hash_long
from skein.session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh directory under the shared checkpoint folder."""
    return os.path.join(checkpoint_dir(spark), f"{name}-{uuid.uuid4().hex[:12]}")


def file_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "parquet",
                glob: str | None = None, max_files_per_trigger: int | None = None) -> DataFrame:
    """A file source over ``directory`` (optionally one file-name glob)."""
    r = spark.readStream.format(fmt).schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(directory)


def _exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def table_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet") -> DataFrame:
    """A table as a file source, be it one file or a folder of files."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory():
        return file_stream(spark, path, schema, fmt)
    return file_stream(spark, os.path.dirname(path), schema, fmt, glob=os.path.basename(path))


def stream_prepare(sdf: DataFrame, prepare: Callable[[DataFrame], DataFrame], sink: str, ckpt: str,
                   available_now: bool = True) -> StreamingQuery:
    """Run the batch pipeline ``prepare`` on every micro-batch and write
    it to ``sink/batch_id=N`` (idempotent overwrite per batch)."""

    def run(batch: DataFrame, batch_id: int) -> None:
        prepare(batch).write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))

    w = sdf.writeStream.foreachBatch(run).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def stream_take(sdf: DataFrame, n: int, sink: str, ckpt: str) -> StreamingQuery:
    """The first ``n`` rows that arrive (streaming global limit)."""
    return sdf.limit(n).writeStream.format("parquet").option("path", sink) \
              .option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def stream_shuffle(sdf: DataFrame, key: Sequence[str], sink: str, ckpt: str, seed: int = 42) -> StreamingQuery:
    """Shuffle buffer = one micro-batch, ordered by md5(seed:shuffle:key);
    ``pos`` continues across batches (offset kept in a small table)."""
    offsets = os.path.join(sink, "_offsets")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        prev = 0
        if _exists(spark, offsets):        # absent before the first batch; a read error is an error
            prev = spark.read.parquet(offsets).filter(F.col("batch_id") < batch_id) \
                        .agg(F.sum("n")).collect()[0][0] or 0
        from skein.operators.ordering import global_index
        h = batch.withColumn("_skein_h", hash_long(seed, F.lit("shuffle"), *[F.col(k) for k in key]))
        out = global_index(h, ["_skein_h", *key], name="pos").drop("_skein_h") \
            .withColumn("pos", F.col("pos") + F.lit(prev))
        out.write.mode("overwrite").parquet(os.path.join(sink, f"batch_id={batch_id}"))
        n = spark.read.parquet(os.path.join(sink, f"batch_id={batch_id}")).count()
        spark.createDataFrame([(batch_id, n)], "batch_id long, n long").write.mode("overwrite") \
             .parquet(os.path.join(offsets, f"b={batch_id}"))

    return sdf.writeStream.foreachBatch(run).option("checkpointLocation", ckpt) \
              .trigger(availableNow=True).start()


def stream_quota(sdf: DataFrame, source: str, by: Sequence[str], q: int, sink: str, ckpt: str) -> StreamingQuery:
    """The first ``q`` rows per source across micro-batches. The state is
    a small table (one row per source per batch) of rows already taken."""
    taken_dir = os.path.join(sink, "_taken")

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rn = F.row_number().over(Window.partitionBy(source).orderBy(*by))
        b = batch.withColumn("_rn", rn).filter(F.col("_rn") <= q)      # literal bound: pruned before the shuffle
        if _exists(spark, taken_dir):      # absent before the first batch; a read error is an error
            seen = spark.read.parquet(taken_dir).filter(F.col("batch_id") < batch_id) \
                        .groupBy(F.col(source).alias("_src")).agg(F.sum("n").alias("_seen"))
            b = b.join(seen, F.col(source).eqNullSafe(F.col("_src")), "left") \
                 .filter(F.col("_rn") <= F.lit(q) - F.coalesce("_seen", F.lit(0))).drop("_src", "_seen")
        b = b.drop("_rn")
        path = os.path.join(sink, f"batch_id={batch_id}")
        b.write.mode("overwrite").parquet(path)
        spark.read.parquet(path).groupBy(source).agg(F.count(F.lit(1)).alias("n")) \
             .withColumn("batch_id", F.lit(batch_id).cast("long")) \
             .write.mode("overwrite").parquet(os.path.join(taken_dir, f"b={batch_id}"))

    return sdf.writeStream.foreachBatch(run).option("checkpointLocation", ckpt) \
              .trigger(availableNow=True).start()


def read_batches(spark: SparkSession, sink: str) -> DataFrame:
    """The output of a foreachBatch sink, all batches."""
    return spark.read.option("basePath", sink).parquet(os.path.join(sink, "batch_id=*"))
