"""Batch planning: rows -> micro-batches -> optimizer steps.

Epochs replicate the (small) index columns with ``explode(sequence(...))``,
each epoch has its own hash order, and positions come from the bucketed
global index partitioned by epoch, so no step of the plan is a single task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.hashing import hash_long
from skein.operators.ordering import global_index

SEED = 42


def plan_batches(df: DataFrame, key: Sequence[str], batch: int, accum: int = 1, drop_last: bool = False,
                 epochs: int = 1, max_steps: int | None = None, seed: int = SEED,
                 shuffle: bool = True) -> DataFrame:
    """Add (epoch, pos, batch, step).

    pos = position inside the epoch (md5(seed:epoch:e:key) order when
    ``shuffle``, else ``key`` order); batch = epoch * batches_per_epoch +
    pos div batch; step = batch div accum. ``drop_last`` drops the incomplete
    last batch of every epoch; ``max_steps`` caps the plan.
    """
    n = df.count()
    per_epoch = n // batch if drop_last else -(-n // batch)
    ep = df.withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(epochs - 1).cast("bigint"))))
    if shuffle:
        ep = ep.withColumn("_skein_h", hash_long(seed, F.lit("epoch"), F.col("epoch"), *[F.col(k) for k in key]))
        ep = global_index(ep, ["_skein_h", *key], "epoch", name="pos").drop("_skein_h")
    else:
        ep = global_index(ep, list(key), "epoch", name="pos")
    out = ep.withColumn("batch", (F.col("epoch") * per_epoch + F.floor(F.col("pos") / batch)).cast("bigint"))
    if drop_last:
        out = out.filter(F.col("pos") < per_epoch * batch)
    out = out.withColumn("step", F.floor(F.col("batch") / accum).cast("bigint"))
    if max_steps is not None:
        out = out.filter(F.col("step") < max_steps)
    return out


def resume(plan: DataFrame, step: int) -> DataFrame:
    """Skip the rows of already completed optimizer steps."""
    return plan.filter(F.col("step") >= step)
