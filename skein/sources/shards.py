"""Training shards with a manifest (S10, S5): versions, reads by position, checks.

A shard set is a folder with ``data/`` (Parquet shards, each a contiguous range
of the order column) and ``manifest/`` (one row a shard: file, rows, bytes,
first and last position, digest). A version is visible once its manifest is
there, and the manifest is written last: a write that breaks off leaves data
files that no reader opens. Writing a version again replaces it; other
versions stay.

A reader takes the files of a version from its manifest, a table of one row a
shard. Reading from a position opens only the shards that reach it, so a
trainer that goes on at step k pays for the rest alone.

Cases: an empty table is a version without shards, read back as no rows; rows whose position is null are refused (they
have no place in the order); equal positions are allowed and may fall into two shards.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

MANIFEST = "version long, file string, n_rows long, n_bytes long, first long, last long, digest string"


def _row_hash(df: DataFrame) -> Column:
    """A 64-bit hash of a row; NULLs take part as a flag, maps as their sorted entries."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        cols += [c.isNull(), F.to_json(F.struct(F.array_sort(F.map_entries(c)))) if f.dataType.typeName() == "map" else c]
    return F.xxhash64(*cols)


def _described(df: DataFrame, order: str, folder: str) -> DataFrame:
    """One row a file of a table read from Parquet; files are named from the set's folder on, so a set can move."""
    return df.select(F.concat(F.lit(f"{folder}/"), F.col("_metadata.file_name")).alias("file"), F.col("_metadata.file_size").alias("size"),
                     F.col(order).cast("long").alias("k"), _row_hash(df).alias("h")) \
        .groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.max("size").cast("long").alias("n_bytes"),
                             F.min("k").alias("first"), F.max("k").alias("last"),
                             F.sum(F.col("h").cast("decimal(20,0)")).cast("string").alias("digest"))


def write_shard_set(df: DataFrame, path: str, version: int, n_shards: int, order: str = "k") -> DataFrame:
    """Write ``df`` as ``n_shards`` shards by ``order`` and publish them as ``version``. Returns the manifest's rows."""
    spark, path = df.sparkSession, path.rstrip("/")
    placed = df.withColumn(order, F.when(F.col(order).isNull(), F.raise_error(F.lit(f"null position in {order}"))
                                         .cast(df.schema[order].dataType)).otherwise(F.col(order)))
    name = f"data/{version}-{uuid.uuid4().hex}"
    folder = f"{path}/{name}"
    placed.repartitionByRange(n_shards, order).sortWithinPartitions(order).write.parquet(folder)
    spark.createDataFrame([(df.schema.json(),)], "schema string").coalesce(1).write.parquet(f"{folder}-schema")
    found = _described(spark.read.schema(df.schema).parquet(folder), order, name)
    # A row without a file carries the folder, so that an empty version is a version.
    rows = found.unionByName(spark.createDataFrame([(name, 0, 0, None, None, "0")],
                                                   "file string, n_rows long, n_bytes long, first long, last long, digest string"))
    # One row a shard: a single file, so that the manifest appears whole.
    rows.withColumn("version", F.lit(version).cast("long")).coalesce(1).write.mode("overwrite") \
        .option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(f"{path}/manifest")
    return manifest(spark, path, version)


def _all_rows(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    m = spark.read.schema(MANIFEST).parquet(f"{path.rstrip('/')}/manifest")
    if version is None:
        version = m.agg(F.max("version")).first()[0]
    return m.filter(F.col("version") == version)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(version, file, n_rows, n_bytes, first, last, digest) of a version, by default the greatest."""
    return _all_rows(spark, path, version).filter("n_rows > 0").select(*[c.split()[0] for c in MANIFEST.split(", ")])


def read_shard_set(spark: SparkSession, path: str, start: int | None = None, stop: int | None = None,
                   version: int | None = None, order: str = "k") -> DataFrame:
    """Rows of a version with start <= order < stop; opens only the shards whose range meets that."""
    rows = _all_rows(spark, path, version).collect()                 # one row a shard
    folder = next((r["file"] for r in rows if not r["n_rows"]), None)
    if folder is None:
        raise ValueError(f"no such version of {path}: {version}")
    path = path.rstrip("/")
    schema = StructType.fromJson(json.loads(spark.read.parquet(f"{path}/{folder}-schema").first()[0]))
    files = [f"{path}/{r['file']}" for r in rows if r["n_rows"] and (start is None or r["last"] >= start)
             and (stop is None or r["first"] < stop)]
    if not files:
        return spark.createDataFrame([], schema)
    df = spark.read.schema(schema).parquet(*files)
    if start is not None:
        df = df.filter(F.col(order) >= start)
    return df if stop is None else df.filter(F.col(order) < stop)


def damaged_shards(spark: SparkSession, path: str, version: int | None = None, order: str = "k") -> DataFrame:
    """Shards whose rows, bytes, range or digest differ from the manifest: (file, n_rows, found_rows). A missing file fails."""
    want = manifest(spark, path, version)
    first = want.first()
    if first is None:
        return want.select("file", "n_rows", F.lit(0).cast("long").alias("found_rows"))
    whole = read_shard_set(spark, path, version=version, order=order)
    found = _described(whole, order, first["file"].rsplit("/", 1)[0]).withColumnRenamed("n_rows", "found_rows")
    same = [F.col(f"w.{c}").eqNullSafe(F.col(f"f.{c}")) for c in ("n_bytes", "first", "last", "digest")]
    return want.alias("w").join(found.alias("f"), F.col("w.file") == F.col("f.file"), "left") \
        .filter(~(same[0] & same[1] & same[2] & same[3]) | ~F.col("w.n_rows").eqNullSafe(F.col("f.found_rows"))) \
        .select("w.file", "w.n_rows", F.coalesce("f.found_rows", F.lit(0)).alias("found_rows"))
