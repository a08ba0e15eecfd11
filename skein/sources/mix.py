"""The source mix: a small table of source specs.

The mix is configuration, a handful of rows built on the driver; everything
it points to is read by Spark.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

log = logging.getLogger(__name__)

# --- fixed values -----------------------------------------------------------
# Keys a source spec may carry, and the defaults of the optional ones.
SPEC_KEYS = ("name", "path", "format", "split", "streaming", "weight", "config", "data_files",
             "sample_ratio", "available_splits", "description")
DEFAULT_SPLIT = "train"
DEFAULT_STREAMING = True
DEFAULT_WEIGHT = 1.0
DEFAULT_FORMAT = "parquet"
# ----------------------------------------------------------------------------

MIX_SCHEMA = T.StructType([
    T.StructField("source", T.StringType(), False),
    T.StructField("src_pos", T.IntegerType(), False),
    T.StructField("path", T.StringType(), True),
    T.StructField("fmt", T.StringType(), False),
    T.StructField("split", T.StringType(), False),
    T.StructField("cfg", T.StringType(), True),
    T.StructField("globs", T.ArrayType(T.StringType()), True),
    T.StructField("streaming", T.BooleanType(), False),
    T.StructField("weight", T.DoubleType(), False),
    T.StructField("sample_ratio", T.DoubleType(), False),
    T.StructField("available_splits", T.ArrayType(T.StringType()), False),
    T.StructField("description", T.StringType(), True),
])


def _num(v, key: str, name: str) -> float:
    # YAML 1.1 loads '1e-5' as a string; accept numeric strings, reject others.
    try:
        return float(v)
    except (TypeError, ValueError) as e:
        raise ValueError(f"source {name!r}: {key} must be a number, got {v!r}") from e


def _bool(v) -> bool:
    if isinstance(v, str):
        return v.strip().lower() in ("1", "true", "yes", "on")
    return bool(v)


def spec_row(spec: dict, pos: int) -> tuple:
    unknown = sorted(set(spec) - set(SPEC_KEYS))
    if unknown:
        raise ValueError(f"unknown source keys {unknown}; allowed: {list(SPEC_KEYS)}")
    if "name" not in spec:
        raise ValueError("a source spec needs a 'name'")
    name = str(spec["name"])
    globs = spec.get("data_files")
    if isinstance(globs, str):
        globs = [globs]
    return (name, pos, spec.get("path"), spec.get("format", DEFAULT_FORMAT), spec.get("split", DEFAULT_SPLIT),
            spec.get("config"), list(globs) if globs else None,
            _bool(spec.get("streaming", DEFAULT_STREAMING)),
            _num(spec.get("weight", DEFAULT_WEIGHT), "weight", name),
            _num(spec.get("sample_ratio", 1.0), "sample_ratio", name),
            [str(s) for s in spec.get("available_splits", [])], spec.get("description"))


def build_mix(spark: SparkSession, specs: list[dict]) -> DataFrame:
    """Validate specs and return the mix table (one row per source, in order)."""
    if not specs:
        raise ValueError("empty source mix")
    rows = [spec_row(s, i) for i, s in enumerate(specs)]
    names = [r[0] for r in rows]
    if len(set(names)) != len(names):
        raise ValueError(f"duplicate source names in {names}")
    validate_mix(rows)
    return spark.createDataFrame(rows, MIX_SCHEMA)


def validate_mix(rows: list[tuple]) -> None:
    """M6: warn when lazily read and eagerly read sources are mixed."""
    flags = {r[7] for r in rows}
    if len(flags) > 1:
        for r in rows:
            if not r[7]:
                log.warning("source %s is not streaming but others are; it is read in full", r[0])
    if sum(r[8] for r in rows) <= 0:
        raise ValueError("source weights must sum to a positive number")
    if any(r[8] < 0 for r in rows):
        raise ValueError("source weights must not be negative")


def normalise_mix(mix: DataFrame) -> DataFrame:
    """M1: weight / sum(weight); the window spans the few mix rows only."""
    total = F.sum("weight").over(Window.partitionBy(F.lit(1)))
    return mix.withColumn("weight_norm", F.col("weight") / total)


def eval_split(mix: DataFrame) -> DataFrame:
    """S8: 'validation' when the source lists it among its splits, else 'train'.
    This overrides the configured split (reference behaviour)."""
    return mix.withColumn("eval_split", F.when(F.array_contains("available_splits", "validation"),
                                               F.lit("validation")).otherwise(F.lit("train")))
