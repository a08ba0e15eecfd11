"""Reading sources by spec, batch and streaming.

A source is a directory (or file globs) in parquet, json-lines or text. Its
named sub-config is a sub-directory and its split a ``split=...`` partition
directory when present, so selecting a split prunes partitions at the scan;
when the data carries no split at all, every row is ``train``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.sampling import SPLIT_COL


def _paths(spec: dict) -> list[str]:
    base = spec.get("path") or spec["name"]
    if spec.get("config"):
        base = os.path.join(base, str(spec["config"]))
    globs = spec.get("data_files")
    if globs:
        globs = [globs] if isinstance(globs, str) else list(globs)
        return [g if os.path.isabs(g) else os.path.join(base, g) for g in globs]
    return [base]


def _tag(df: DataFrame, spec: dict, split: str) -> DataFrame:
    name = str(spec["name"])
    if SPLIT_COL in df.columns:
        df = df.filter(F.col(SPLIT_COL) == split)
    else:
        if split != "train":
            raise ValueError(f"source {name!r} has no split column or directory; cannot read {split!r}")
        df = df.withColumn(SPLIT_COL, F.lit(split))
    return df.withColumn("source", F.lit(name))


def read_source(spark: SparkSession, spec: dict, split: str | None = None,
                schema: T.StructType | None = None) -> DataFrame:
    """Batch read of one source, tagged with source and split."""
    fmt = spec.get("format", "parquet")
    split = split or spec.get("split", "train")
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(_paths(spec))
    return _tag(df, spec, split)


def read_source_stream(spark: SparkSession, spec: dict, schema: T.StructType, split: str | None = None,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """The same source as a file stream (schema required, as for any
    production stream); combine with ``trigger(availableNow=True)`` for an
    incremental catch-up run."""
    fmt = spec.get("format", "parquet")
    split = split or spec.get("split", "train")
    paths = _paths(spec)
    if len(paths) != 1:
        raise ValueError("a streaming source reads one directory; use pathGlobFilter for subsets")
    reader = spark.readStream.format(fmt).schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return _tag(reader.load(paths[0]), spec, split)


def read_mix(spark: SparkSession, specs: list[dict], split: str | None = None,
             columns: list[str] | None = None) -> DataFrame:
    """All sources of a mix as one DataFrame (M5 concatenation by name)."""
    out = None
    for spec in specs:
        df = read_source(spark, spec, split)
        if columns:
            df = df.select(*columns, "source", SPLIT_COL)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out

