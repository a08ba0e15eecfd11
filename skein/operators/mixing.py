"""Weighted interleave, shuffles and concatenation of sources (M1-M7).

The interleave is planned on integers only: output position k draws a source
with probability w from u = md5(seed:mix:k); the draw number c of that source is
a running count over k (bucketed prefix sum, no single-task window); the row
taken is c mod n (sources restart when exhausted) and epoch = c div n. The
stopping point K depends on the draws, so a candidate K0 is planned, checked,
and doubled until every source is covered. The payload rows are joined last.

Hot keys: a tiny source with a large weight repeats its rows many times. The
plan side is salted by epoch (salt = epoch mod S_s) and each row of that
source is replicated S_s times on the data side, where S_s is the source's epoch
count, so the replicated data never exceeds the plan size.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.hashing import hash_long, hash_uniform
from skein.operators.ordering import drop_bucket, equal_buckets, global_index, prefix_sum
from skein.session import shuffle_partitions, stored

SEED = 42
HASH_SPAN = 1 << 60                # hash_long draws from [0, 2^60)
K_SLACK = 1.25


def source_choice(u: Column, sources: Sequence[str], weights: Sequence[float]) -> Column:
    """Source whose cumulative-weight interval contains u (weights normalised).

    The mix is a few rows of configuration, so this is a short CASE chain."""
    total = float(sum(weights))
    expr = None
    cum = 0.0
    for i, (s, w) in enumerate(zip(sources, weights)):
        if w <= 0:
            continue
        cum += w / total
        bound = 1.0 if i == len(sources) - 1 else cum
        cond = u < F.lit(bound)
        expr = F.when(cond, F.lit(s)) if expr is None else expr.when(cond, F.lit(s))
    last = [s for s, w in zip(sources, weights) if w > 0][-1]
    return expr.otherwise(F.lit(last))


def draw_plan(spark: SparkSession, sizes: dict[str, int], weights: dict[str, float], seed: int = SEED,
              stop: str = "all_exhausted", k0: int | None = None) -> DataFrame:
    """M2/M3: (k, source, c, row, epoch) for output positions 0..K-1."""
    names = list(sizes)
    w = [float(weights.get(s, 1.0)) for s in names]
    if sum(w) <= 0:
        raise ValueError("weights must sum to a positive number")
    live = [s for s, x in zip(names, w) if x > 0]
    empty = [s for s in live if sizes[s] <= 0]
    if empty:
        raise ValueError(f"sources without rows cannot be interleaved: {empty}")
    tot = sum(w)
    need = max(sizes[s] / (weights.get(s, 1.0) / tot) for s in live)
    k0 = k0 or int(math.ceil(need * K_SLACK)) + 64
    while True:
        plan = spark.range(k0).withColumnRenamed("id", "k") \
            .withColumn("source", source_choice(hash_uniform(seed, F.lit("mix"), F.col("k")), names, w))
        plan = drop_bucket(prefix_sum(equal_buckets(plan, "k", k0), F.lit(1), ["k"], "source", name="c",
                                      inclusive=False))
        n_col = F.create_map(*[x for s in live for x in (F.lit(s), F.lit(int(sizes[s])))])
        plan = stored(plan.withColumn("n", n_col[F.col("source")]), "draws")    # planned once, read from here on
        if stop == "all_exhausted":
            ends = plan.filter(F.col("c") == F.col("n") - 1).groupBy("source").agg(F.min("k").alias("k_end"))
            got = {r["source"]: r["k_end"] for r in ends.collect()}
            if len(got) == len(live):
                K = max(got.values()) + 1
                break
        elif stop == "first_exhausted":
            # the first position that gives a source's last row ends the mix
            k_end = plan.filter(F.col("c") == F.col("n") - 1).agg(F.min("k").alias("k_end")).collect()[0]["k_end"]
            if k_end is not None:
                K = int(k_end) + 1
                break
        else:
            raise ValueError(f"unknown stopping strategy {stop!r}")
        k0 *= 2
    plan = plan.filter(F.col("k") < K)
    return plan.select("k", "source", "c", (F.col("c") % F.col("n")).alias("row"),
                       F.floor(F.col("c") / F.col("n")).cast("bigint").alias("epoch"))


def epoch_salts(plan: DataFrame, sizes: dict[str, int]) -> dict[str, int]:
    """Salt count per source: its number of epochs in the plan.

    A source read e times repeats each row e times; with e salts a join key
    holds one plan row per payload row, and replicating the payload e times
    makes no more rows than the plan has."""
    n_draws = plan.groupBy("source").agg(F.count(F.lit(1)).alias("d")).collect()  # one row per source
    return {r["source"]: max(1, math.ceil(r["d"] / sizes[r["source"]])) for r in n_draws}


def salted_join(plan: DataFrame, payload: DataFrame, keys: Sequence[str], salts: dict[str, int],
                epoch: str = "epoch") -> DataFrame:
    """Join plan rows (which repeat payload keys once per epoch) to payload
    rows on ``keys`` (which include ``source``) without a hot key: the plan
    side gets salt = epoch mod S_source, the payload side is replicated S times."""
    salt_map = F.create_map(*[x for s, v in salts.items() for x in (F.lit(s), F.lit(v))])
    p = plan.withColumn("_skein_salt", (F.col(epoch) % salt_map[F.col("source")]).cast("int"))
    d = payload.withColumn("_skein_salt", F.explode(F.sequence(F.lit(0), salt_map[F.col("source")] - 1)))
    return p.join(d, [*keys, "_skein_salt"]).drop("_skein_salt")


def interleave(spark: SparkSession, data: DataFrame, weights: dict[str, float], by: Sequence[str],
               seed: int = SEED, stop: str = "all_exhausted") -> DataFrame:
    """M2/M3 on rows: ``data`` has a ``source`` column and a unique order ``by``
    within each source. Returns data columns + (k, epoch)."""
    sizes_rows = data.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per source
    sizes = {r["source"]: int(r["n"]) for r in sizes_rows if weights.get(r["source"], 1.0) > 0}
    order = [s for s in weights if s in sizes]
    sizes = {s: sizes[s] for s in order}
    plan = draw_plan(spark, sizes, weights, seed, stop)
    salts = epoch_salts(plan, sizes)
    pos = global_index(data.filter(F.col("source").isin(list(sizes))), by, "source", name="row")
    return salted_join(plan, pos, ["source", "row"], salts).drop("c")


def shuffle_global(df: DataFrame, key: Sequence[str], seed: int = SEED, name: str = "pos") -> DataFrame:
    """M4 (global): position in the order of md5(seed:shuffle:key); exact,
    repeatable, and independent of the interleave draws (own tag)."""
    h = hash_long(seed, F.lit("shuffle"), *[F.col(k) for k in key])
    even = equal_buckets(df.withColumn("_skein_h", h), "_skein_h", HASH_SPAN)
    return drop_bucket(global_index(even, ["_skein_h", *key], name=name)).drop("_skein_h")


def shuffle_buffered(df: DataFrame, position: str, buffer: int, seed: int = SEED, name: str = "pos") -> DataFrame:
    """M4 (buffered): shuffle inside consecutive windows of ``buffer`` rows of
    ``position``. Each window is bounded by ``buffer`` rows."""
    blk = F.floor(F.col(position) / buffer).cast("bigint")
    h = hash_long(seed, F.lit("shuffle"), F.col(position))
    rn = F.row_number().over(Window.partitionBy("_skein_blk").orderBy(h, F.col(position)))
    out = df.withColumn("_skein_blk", blk).withColumn(name, (F.col("_skein_blk") * buffer + rn - 1).cast("bigint"))
    return out.drop("_skein_blk")


def concat(dfs: Sequence[DataFrame]) -> DataFrame:
    """M5: union by column name (missing columns as NULL)."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def shuffle_reservoir(df: DataFrame, position: str, buffer: int, seed: int = SEED, name: str = "pos") -> DataFrame:
    """M4 (buffered, as a stream does it): the order in which a shuffle buffer of ``buffer`` rows gives the rows
    out. ``position`` numbers the rows from 0.

    The buffer is filled with the first rows; each further row t draws slot s(t) = md5(seed:slot:t) mod buffer,
    gives out the row held there and takes its place; at the end the rows left come out in the order of md5(seed:rest:slot).
    So a row put into a slot at t leaves at that slot's next draw: one window over (slot, t), no loop. With few
    slots, a slot's rows are cut into ranges of t and the next draw beyond a range is the first one of a later range."""
    n = df.count()
    slots = max(1, min(buffer, n))
    parts = 4 * shuffle_partitions(df.sparkSession)
    t = F.col(position)
    drawn = (hash_long(seed, F.lit("slot"), t) % buffer).cast("bigint")
    rows = df.withColumn("_skein_slot", F.when(t < buffer, t).otherwise(drawn).cast("bigint"))
    if slots >= parts:
        rows = rows.withColumn("_skein_next", F.lead(position).over(Window.partitionBy("_skein_slot").orderBy(position)))
    else:
        rows = equal_buckets(rows, position, max(n, 1))
        own = Window.partitionBy("_skein_slot", "_skein_bucket").orderBy(position)
        later = Window.partitionBy("_skein_slot").orderBy(F.desc("_skein_bucket"))
        firsts = rows.groupBy("_skein_slot", "_skein_bucket").agg(F.min(position).alias("_skein_first")) \
            .withColumn("_skein_after", F.lag("_skein_first").over(later)).drop("_skein_first")   # slots x ranges rows at most
        rows = rows.withColumn("_skein_next", F.lead(position).over(own)) \
            .join(firsts, ["_skein_slot", "_skein_bucket"]) \
            .withColumn("_skein_next", F.coalesce("_skein_next", "_skein_after")).drop("_skein_after", "_skein_bucket")
    rest = df.sparkSession.range(slots).withColumnRenamed("id", "_skein_slot") \
        .withColumn("_skein_h", hash_long(seed, F.lit("rest"), F.col("_skein_slot")))
    rest = drop_bucket(global_index(equal_buckets(rest, "_skein_h", HASH_SPAN), ["_skein_h", "_skein_slot"], name="_skein_rest")) \
        .drop("_skein_h")
    out = rows.join(rest, "_skein_slot", "left")
    return out.withColumn(name, F.coalesce(F.col("_skein_next") - buffer, F.lit(n - slots) + F.col("_skein_rest")).cast("bigint")) \
        .drop("_skein_slot", "_skein_next", "_skein_rest")
