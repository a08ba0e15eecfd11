"""Epoch orders by a keyed permutation of row numbers.

A generalised Feistel network over [0, a) x [0, b), a * b >= n, permutes the
numbers below a * b; walking its cycle until the value falls below n makes it a
permutation of [0, n) (a * b exceeds n by less than a, so few values walk at
all). Rows are numbered once; the position in any epoch is a projection of that
number, so epochs cost no sort and no exchange, and the inverse tells which row
stands at a position without the plan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators.ordering import global_index

SEED = 42
ROUNDS = 6
WALKS = 24                          # values that walk longer raise; none can where a <= WALKS
MODULUS, STEP, MIX = 2147483647, 48271, 69621      # 2^31 - 1 and two multipliers


def sides(n: int) -> tuple[int, int]:
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def round_keys(seed: int, epoch: int) -> list[int]:
    """A key below 2^30 for each round, from md5('seed:feistel:epoch:round')."""
    return [int(hashlib.md5(f"{seed}:feistel:{epoch}:{r}".encode()).hexdigest()[:15], 16) % (1 << 30) for r in range(ROUNDS)]


def _mixed(x: Column, key: Column) -> Column:
    y = (x + key) % MODULUS * STEP % MODULUS
    return y.bitwiseXOR(F.shiftright(y, 15)) * MIX % MODULUS


def _network(x: Column, a: int, b: int, keys: Sequence[Column], back: bool) -> Column:
    """One pass of the network, or of its inverse, over [0, a * b)."""
    pair = F.struct(F.call_function("div", x, F.lit(b).cast("bigint")).alias("l"), (x % b).cast("bigint").alias("r"))
    steps = list(enumerate(keys))
    # the network as a fold over (side, key), so that each half is computed once a round
    plan = F.array(*[F.struct(F.lit(i % 2).alias("side"), k.cast("bigint").alias("key")) for i, k in (steps[::-1] if back else steps)])
    sign = -1 if back else 1

    def turn(s, p):
        left = F.when(p["side"] == 0, F.pmod(s["l"] + sign * _mixed(s["r"], p["key"]), F.lit(a))).otherwise(s["l"])
        right = F.when(p["side"] == 1, F.pmod(s["r"] + sign * _mixed(s["l"], p["key"]), F.lit(b))).otherwise(s["r"])
        return F.struct(left.cast("bigint").alias("l"), right.cast("bigint").alias("r"))

    return F.aggregate(plan, pair, turn, lambda s: s["l"] * b + s["r"])


def permute(x: Column, n: int, keys: Sequence[Column], back: bool = False) -> Column:
    """Where the permutation of [0, n) with these keys sends ``x`` (``back``: the number that it sends to ``x``)."""
    a, b = sides(n)
    if a * b == n:
        return _network(x, a, b, keys, back)
    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), _network(x, a, b, keys, back),
                         lambda v, _: F.when(v < n, v).otherwise(_network(v, a, b, keys, back)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("a value did not return in WALKS steps")).cast("bigint"))


def epoch_table(epochs: int, seed: int) -> Column:
    """The epochs and their keys as a literal array (a few numbers an epoch)."""
    return F.array(*[F.struct(F.lit(e).cast("bigint").alias("epoch"), F.array(*[F.lit(k).cast("bigint") for k in round_keys(seed, e)]).alias("keys"))
                     for e in range(epochs)])


def plan_epochs(df: DataFrame, key: Sequence[str], batch: int, accum: int = 1, drop_last: bool = False, epochs: int = 1,
                max_steps: int | None = None, seed: int = SEED, index: str | None = None) -> DataFrame:
    """(epoch, pos, batch, step) like ``plan_batches``, with one numbering for all epochs.

    ``index`` names a column that already numbers the rows from 0; otherwise rows are numbered in ``key`` order.
    An epoch that ``max_steps`` never reaches is not planned."""
    n = df.count()
    per_epoch = n // batch if drop_last else -(-n // batch)
    if max_steps is not None and per_epoch:
        epochs = min(epochs, -(-max_steps * accum // per_epoch))
    ranked = df.withColumn("_skein_idx", F.col(index)) if index else global_index(df, list(key), name="_skein_idx")
    if epochs <= 0 or n == 0:
        ranked, epochs = ranked.filter("false"), 1
    out = ranked.withColumn("_skein_e", F.explode(epoch_table(epochs, seed))) \
        .withColumn("epoch", F.col("_skein_e.epoch")) \
        .withColumn("pos", permute(F.col("_skein_idx"), max(n, 1), [F.get("_skein_e.keys", F.lit(r)) for r in range(ROUNDS)])) \
        .drop("_skein_e", "_skein_idx")
    out = out.withColumn("batch", (F.col("epoch") * per_epoch + F.floor(F.col("pos") / batch)).cast("bigint"))
    if drop_last:
        out = out.filter(F.col("pos") < per_epoch * batch)
    out = out.withColumn("step", F.floor(F.col("batch") / accum).cast("bigint"))
    return out if max_steps is None else out.filter(F.col("step") < max_steps)


def rows_of_steps(spark: SparkSession, n: int, batch: int, accum: int, first_step: int, last_step: int,
                  drop_last: bool = False, seed: int = SEED) -> DataFrame:
    """(epoch, pos, batch, step, idx) of the steps [first_step, last_step) alone: positions are turned back
    into row numbers, so resuming at any step neither builds nor filters the plan."""
    per_epoch = n // batch if drop_last else -(-n // batch)
    if per_epoch == 0 or last_step <= first_step:
        return spark.range(0).select(*[F.col("id").alias(c) for c in ("epoch", "pos", "batch", "step", "idx")])
    lo, hi = first_step * accum, last_step * accum                     # batches
    epochs = list(range(lo // per_epoch, (hi - 1) // per_epoch + 1))
    keys = {e: round_keys(seed, e) for e in epochs}
    rows = spark.range(lo, hi).withColumnRenamed("id", "batch") \
        .withColumn("epoch", F.floor(F.col("batch") / per_epoch).cast("bigint")) \
        .withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(batch - 1)))) \
        .withColumn("pos", ((F.col("batch") % per_epoch) * batch + F.col("_at")).cast("bigint")).filter(F.col("pos") < n)
    key_of = F.create_map(*[x for e in epochs for x in (F.lit(e).cast("bigint"), F.array(*[F.lit(k).cast("bigint") for k in keys[e]]))])
    rows = rows.withColumn("_keys", key_of[F.col("epoch")])
    idx = permute(F.col("pos"), n, [F.get("_keys", F.lit(r)) for r in range(ROUNDS)], back=True)
    return rows.select("epoch", "pos", "batch", F.floor(F.col("batch") / accum).cast("bigint").alias("step"), idx.alias("idx"))
