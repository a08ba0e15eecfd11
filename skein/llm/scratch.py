"""Intermediate tables in the shared folder, and connected components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.session import bound_batches, checkpoint_dir  # noqa: F401


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under ``spark.checkpoint.dir``."""
    return f"{checkpoint_dir(spark).rstrip('/')}/skein-llm/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts lineage:
    a lost executor costs no more than the tasks it was running."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(df: DataFrame) -> None:
    """Delete the files of a saved table that no later plan reads."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for d in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/skein-llm/" in d:
            p = jvm.org.apache.hadoop.fs.Path(d)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _fingerprint(links: DataFrame) -> tuple:
    """Row count and sum of 64-bit hashes: equal for equal sets of links (and hardly ever otherwise)."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the links (a, b); root is the smallest
    node reachable.

    Alternating large-star and small-star rounds: each hangs nodes under the
    smallest neighbour by grouped minima, so a component of any shape becomes
    a star after O(log n) rounds. Only grouped minima are taken, never lists
    of neighbours, so a hub costs partial aggregates and one join. Links stay
    distributed; each round is a table in the shared folder. Raises if
    ``max_rounds`` rounds do not finish (2^30 nodes in a path need fewer).
    """
    cur = save(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
               .filter("u <> v").distinct(), "cc")
    last = _fingerprint(cur)
    for _ in range(max_rounds):
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        # large-star: neighbours above a node hang under the node's minimum
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small-star: a node and its smaller neighbours hang under the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")) \
            .unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        nxt = save(small, "cc")
        now = _fingerprint(nxt)
        same, last = now == last, now
        drop_saved(cur)
        cur = nxt
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
