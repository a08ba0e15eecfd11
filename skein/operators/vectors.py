"""Keyed vector tables (J1-J6) and vector RMS norm.

A keyed vector table is (id, vec ARRAY<double>). Sums and means keep one row
per id: one aggregate per dimension under a single group-by with map-side
partial aggregation, the distributed equivalent of gathering all (id,
gradient) pairs and scatter-adding them. A hot id is combined inside every
task before the shuffle. Updates join arrays on the id and work element-wise.
Lookups are equi-joins; the vector side is broadcast only when its measured
size is small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import hash_normal

LR = 1e-3
WEIGHT_DECAY = 1e-2
RMS_EPS = 1e-5
INIT_STD = 0.02


BROADCAST_BYTES = 64 << 20


def lookup_vectors(df: DataFrame, keys: Sequence[str], ids: str, vec: DataFrame, vkey: str = "id",
                   varr: str = "vec", vec_rows: int | None = None) -> DataFrame:
    """One row per (row, position) with the vector of its id (inner join:
    ids without a vector are dropped).

    Token ids are heavily skewed (a common token can be a third of all rows),
    so a vector table of at most ``vec_rows`` rows (for example one per word of
    a vocabulary) is broadcast if its measured bytes stay under
    ``BROADCAST_BYTES``; otherwise AQE decides and splits skewed partitions."""
    ex = df.select(*keys, F.posexplode(ids).alias("pos", "_skein_id"))
    v = vec.select(F.col(vkey).alias("_skein_id"), F.col(varr).alias("vec"))
    if vec_rows is not None:
        size = v.limit(vec_rows + 1).agg(F.count(F.lit(1)).alias("n"), F.sum(8 * F.size("vec") + 16).alias("b")).first()
        if size["n"] <= vec_rows and (size["b"] or 0) <= BROADCAST_BYTES:
            v = F.broadcast(v)
    return ex.join(v, "_skein_id").withColumnRenamed("_skein_id", "id")


def frequent(df: DataFrame, column: str, counters: int = 1024) -> DataFrame:
    """(value, least): the values that may hold over 1 / ``counters`` of all rows, with a lower bound of their count.

    Each task keeps a Misra-Gries summary of ``counters`` values, so what it emits and holds is bounded and every
    value of such a share in the whole table is among them. NULLs are left out."""
    kind = df.select(column).schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        value, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            new = b.column(0).drop_null().to_numpy(zero_copy_only=False).astype(np.int64)
            value, place = np.unique(np.concatenate([value, new]), return_inverse=True)
            count = np.bincount(place, np.concatenate([count, np.ones(len(new), np.int64)]), len(value)).astype(np.int64)
            if len(value) > counters:                                   # all lose as much as the first one left out has
                count -= np.partition(count, -counters - 1)[-counters - 1]
                value, count = value[count > 0], count[count > 0]
        yield pa.RecordBatch.from_pydict({"value": pa.array(value), "least": pa.array(count)})

    return df.select(F.col(column).cast("bigint")).mapInArrow(run, "value bigint, least bigint") \
        .groupBy("value").agg(F.sum("least").alias("least")).select(F.col("value").cast(kind).alias("value"), "least")


def lookup_vectors_split(df: DataFrame, keys: Sequence[str], ids: str, vec: DataFrame, vkey: str = "id", varr: str = "vec",
                         counters: int = 1024) -> DataFrame:
    """J1 for skewed ids and a vector table of any size: the rows of ``lookup_vectors``.

    Frequent ids (``frequent``; at most ``counters``, and fewer where their vectors would pass
    ``BROADCAST_BYTES``) meet their vectors by a broadcast, without a shuffle; the others, none of which fills a task, by
    a shuffle join."""
    ex = df.select(*keys, F.posexplode(ids).alias("pos", "_skein_id"))
    v = vec.select(F.col(vkey).alias("_skein_id"), F.col(varr).alias("vec"))
    longest = v.agg(F.max(F.size("vec"))).first()[0] or 0
    most = max(1, min(counters, BROADCAST_BYTES // (8 * longest + 16)))
    hot = [r["value"] for r in frequent(ex, "_skein_id", counters).orderBy(F.desc("least"), "value").limit(most).collect()]
    if not hot:
        return ex.join(v, "_skein_id").withColumnRenamed("_skein_id", "id")
    kind = v.schema["_skein_id"].dataType
    few = df.sparkSession.createDataFrame([(h,) for h in hot], "_skein_id long").select(F.col("_skein_id").cast(kind))
    near = ex.join(F.broadcast(v.join(F.broadcast(few), "_skein_id", "left_semi")), "_skein_id")
    far = ex.join(F.broadcast(few), "_skein_id", "left_anti").join(v.join(F.broadcast(few), "_skein_id", "left_anti"), "_skein_id")
    return near.unionByName(far).withColumnRenamed("_skein_id", "id")


def _width(df: DataFrame, arr: str, width: int | None) -> int:
    """Number of dimensions: given, or the longest array (one pass)."""
    return width if width is not None else (df.agg(F.max(F.size(arr))).first()[0] or 0)


def _dims(arr: str, width: int, agg) -> Column:
    """One aggregate per dimension, gathered into an array; a missing element counts as NULL."""
    cols = [agg(F.get(F.col(arr), F.lit(i)).cast("double")) for i in range(width)]
    return F.array(*cols) if cols else F.array().cast("array<double>")


def mean_pool(looked: DataFrame, keys: Sequence[str], width: int | None = None) -> DataFrame:
    """Average of the looked-up vectors per row: (keys..., vec, n_found)."""
    n = _width(looked, "vec", width)
    return looked.groupBy(*keys).agg(_dims("vec", n, F.avg).alias("vec"), F.count(F.lit(1)).alias("n_found"))


def sum_vectors(grads: DataFrame, key: str = "id", arr: str = "grad", width: int | None = None) -> DataFrame:
    """Per distinct id, the element-wise sum of its vectors: (key, grad, n)."""
    d = _width(grads, arr, width)
    return grads.groupBy(key).agg(_dims(arr, d, F.sum).alias("grad"), F.count(F.lit(1)).alias("n"))


def sign_update(weights: DataFrame, grads: DataFrame, lr: float = LR, weight_decay: float = WEIGHT_DECAY,
                key: str = "id") -> DataFrame:
    """Sign descent with decoupled weight decay on touched ids only:
    w <- w * (1 - lr * wd) - lr * sign(g); an id or dimension without a
    gradient keeps w. ``weights`` = (key, w), ``grads`` = (key, grad), both arrays."""
    j = weights.join(grads.select(key, "grad"), key, "left")

    def one(w, g):
        return F.when(g.isNull(), w).otherwise(w * F.lit(1.0 - lr * weight_decay) - F.lit(lr) * F.signum(g))

    new = F.slice(F.zip_with("w", "grad", one), F.lit(1), F.size("w"))
    return j.select(key, F.when(F.col("grad").isNull(), F.col("w")).otherwise(new).alias("w"),
                    F.col("grad").isNotNull().alias("updated"))


def refresh(old: DataFrame, new: DataFrame, flag: DataFrame, key: str = "slot") -> DataFrame:
    """Rows whose flag is set take the new batch's values, others keep
    theirs. ``flag`` is (key, halted); all three are keyed by ``key``."""
    cols = [c for c in old.columns if c != key]
    n = new.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols])
    j = old.join(flag, key, "left").join(n, key, "left")
    take = F.coalesce(F.col("halted"), F.lit(False)) & F.col(f"_new_{cols[0]}").isNotNull()
    return j.select(key, *[F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in cols],
                    take.alias("refreshed"))


def resize_vectors(vec: DataFrame, old_n: int, new_n: int, dim: int, seed: int = 42,
                   std: float = INIT_STD, key: str = "id", arr: str = "vec") -> DataFrame:
    """Keep ids < min(old_n, new_n); ids old_n..new_n-1 get N(0, std)
    values from md5(seed:id:dim), so re-running gives the same table."""
    keep = vec.filter(F.col(key) < min(old_n, new_n)).select(key, F.col(arr).cast("array<double>").alias(arr),
                                                          F.lit(False).alias("is_new"))
    if new_n <= old_n:
        return keep
    spark = vec.sparkSession
    new = spark.range(old_n, new_n).withColumnRenamed("id", key)
    new = new.select(key, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)),
                                      lambda d: hash_normal(seed, F.col(key), d) * F.lit(std)).alias(arr),
                     F.lit(True).alias("is_new"))
    return keep.unionByName(new)


def rms_norm(arr: Column | str, eps: float = RMS_EPS) -> Column:
    """x / sqrt(mean(x^2) + eps) over one vector."""
    x = F.col(arr).cast("array<double>") if isinstance(arr, str) else arr
    ms = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v) / F.size(x)
    return F.transform(x, lambda v: v / F.sqrt(ms + F.lit(eps)))
