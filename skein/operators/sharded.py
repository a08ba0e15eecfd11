"""Losses over a vocabulary cut into shards.

A token's logits come as several rows (keys, label, shard, block), block i of
shard j being class j * width + i, as a model that is split by vocabulary gives
them out. Each row is reduced where it is: its maximum and the sum of exp(x - maximum) (softmax) or of
the stablemax terms, the label's logit if the label falls into the shard, and the best class. Only
these few numbers are shuffled, one small row a shard, and merged per token:
(m, s) and (m', s') make (M = max, s * exp(m - M) + s' * exp(m' - M)). No array is
as long as the vocabulary; the list that is merged has one entry a shard.

Cases: the last shard may be shorter; an empty or null block counts as no classes; a label
outside of all shards gives a null loss; ignored labels give 0. A shard of -infinity alone adds nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions.arrays import IGNORE_LABEL, stablemax_s


def shard_logits(pred: DataFrame, width: int, logits: str = "logits") -> DataFrame:
    """Rows of whole logits cut into shards of ``width`` classes."""
    n = F.ceil(F.size(logits) / F.lit(width)).cast("int")
    cut = pred.withColumn("shard", F.explode(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))))
    return cut.withColumn("block", F.slice(logits, F.col("shard") * width + 1, F.lit(width))).drop(logits)


def score_shards(shards: DataFrame, keys: Sequence[str], width: int, kind: str = "softmax", label: str = "label",
                 ignore: int = IGNORE_LABEL) -> DataFrame:
    """(keys, label, valid, correct, nll) per token, as ``score_tokens`` gives from whole logits (lowest class wins ties)."""
    if kind not in ("softmax", "stablemax"):
        raise ValueError(f"unknown loss {kind!r}")
    x = F.transform(F.coalesce("block", F.array().cast("array<double>")), lambda v: v.cast("double"))
    inside = (F.col(label) >= F.col("shard") * width) & (F.col(label) < F.col("shard") * width + F.size("_x"))
    m = F.array_max("_x")
    if kind == "softmax":
        s = F.when(m == F.lit(float("-inf")), F.lit(0.0)).otherwise(
            F.aggregate("_x", F.lit(0.0), lambda a, v: a + F.exp(v - F.col("_m"))))
        own = F.get("_x", (F.col(label) - F.col("shard") * width).cast("int"))
    else:
        s = F.aggregate("_x", F.lit(0.0), lambda a, v: a + stablemax_s(v))
        own = stablemax_s(F.get("_x", (F.col(label) - F.col("shard") * width).cast("int")))
    small = shards.withColumn("_x", x).filter(F.size("_x") > 0).withColumn("_m", m).select(
        *keys, label, F.struct(F.col("shard"), F.col("_m").alias("m"), s.alias("s")).alias("part"),
        F.when(inside, own).alias("own"),
        F.struct(F.col("_m").alias("m"), (-(F.col("shard") * width + F.array_position("_x", F.col("_m")) - 1)).cast("bigint").alias("c")).alias("best"))
    token = small.groupBy(*keys, label).agg(F.array_sort(F.collect_list("part")).alias("parts"), F.max("own").alias("own"),
                                            F.max("best").alias("best"))       # one entry a shard
    if kind == "softmax":
        top = F.col("best.m")
        total = F.aggregate("parts", F.lit(0.0), lambda a, p: a + F.when(p["s"] == 0, F.lit(0.0)).otherwise(p["s"] * F.exp(p["m"] - top)))
        loss = top + F.log(total) - F.col("own")
    else:
        loss = -F.log(F.col("own") / F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["s"]))
    valid = F.col(label) != ignore
    return token.select(*keys, label, valid.alias("valid"), (valid & (-F.col("best.c") == F.col(label))).alias("correct"),
                        F.when(valid, loss).otherwise(F.lit(0.0)).alias("nll"))
