"""Session helpers.

The library never creates a session behind the caller's back; ``get_spark``
is for scripts, tests and the bench. Cluster settings (shuffle partitions,
checkpoint directory) are read from the active session and only filled in
where they are unset.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, cpus: int | None = None,
              shuffle_partitions: int | None = None, app: str = "skein") -> SparkSession:
    cpus = cpus or int(os.environ.get("BENCH_CPUS", "8"))
    master = master or f"local[{cpus}]"
    parts = shuffle_partitions or cpus
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SKEIN_DRIVER_MEMORY", "16g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint directory named by the cluster.

    On a cluster ``spark.checkpoint.dir`` points at shared storage and is
    used as is; if it is unset there, this raises rather than falling back to
    a machine-local folder. Only in local mode (tests, the bench) is a
    directory created when the setting is missing.
    """
    conf = spark.sparkContext.getConf()
    path = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; point it at a shared folder (e.g. HDFS/S3)")
        path = tempfile.mkdtemp(prefix="skein-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", path)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table once under the shared checkpoint folder and read it back:
    later steps read the files instead of repeating the plan behind them."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Let an Arrow batch of texts hold ``BATCH_BYTES`` at most (a row at least),
    which bounds the memory of Python workers. Lowers the session's limit,
    never raises it."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, "64m").strip().lower()
    number, unit = now.rstrip("bkmg"), now[len(now.rstrip("bkmg")):]
    factor = {"": 1, "b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20, "g": 1 << 30, "gb": 1 << 30}[unit]
    if int(number) <= 0 or int(number) * factor > BATCH_BYTES:
        spark.conf.set(name, f"{BATCH_BYTES}b")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
