"""Limits, slices, splits and samples in an explicit order.

``limit`` without an order is not deterministic in Spark, so every operator
takes ``by``: a unique ordering whose leading column is numeric; NULL keys
sort first. Two plans give the same rows: Spark's top-k (a bounded heap per
task), and the bucketed global index, where no task holds more than a bucket.
``how`` names one; the default picks top-k where it ships few rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.hashing import hash_long, hash_uniform
from skein.operators.ordering import global_index

# Plan choice only, never the answer: top-k ships up to n rows of every task to one task.
TOP_K_ROWS = 10_000
# Spark prunes row_number() <= q per task before the shuffle up to its windowGroupLimitThreshold.
GROUP_TOP_K_ROWS = 1000
SPLIT_COL = "split"


def head_n(df: DataFrame, by: Sequence[str], n: int | None, how: str = "auto") -> DataFrame:
    """L1: the first min(len, n) rows in ``by`` order; ``n=None`` keeps all."""
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    if how == "topk" or (how == "auto" and n <= TOP_K_ROWS):
        return df.orderBy(*by).limit(n)
    return global_index(df, by, name="_skein_pos").filter(F.col("_skein_pos") < n).drop("_skein_pos")


def slice_rows(df: DataFrame, by: Sequence[str], start: int, stop: int) -> DataFrame:
    """L2: rows at positions [start, stop) in ``by`` order."""
    ix = global_index(df, by, name="_skein_pos")
    return ix.filter((F.col("_skein_pos") >= start) & (F.col("_skein_pos") < stop)).drop("_skein_pos")


def tail_split(df: DataFrame, by: Sequence[str], train_frac: float = 0.9,
               max_train: int | None = None, max_eval: int | None = None) -> DataFrame:
    """L3: cap to ``max_train`` (L1), then train = first int(len*0.9) rows and
    eval = the rest, eval capped to ``max_eval``. Adds ``split`` and ``pos``.

    ``len`` is one scalar count; positions come from the bucketed index.
    """
    n = df.count()                     # counts the input, not the index built on it
    ix = global_index(df, by, name="pos")
    if max_train is not None:
        n = min(n, max_train)
        ix = ix.filter(F.col("pos") < max_train)
    cut = int(n * train_frac)
    out = ix.withColumn(SPLIT_COL, F.when(F.col("pos") < cut, F.lit("train")).otherwise(F.lit("validation")))
    if max_eval is not None:
        out = out.filter((F.col("pos") < cut) | (F.col("pos") < cut + max_eval))
    return out


def select_split(df: DataFrame, name: str) -> DataFrame:
    """Keep one split (a partition filter when ``split`` is a directory)."""
    return df.filter(F.col(SPLIT_COL) == name)


def _first_q(df: DataFrame, group: str, order: list, q: int, rank: str | None = None,
             how: str = "auto") -> DataFrame:
    """Rows ranked 1..q per group in ``order`` (``rank`` keeps the 1-based rank);
    NULL is a group like any other.

    ``topk``: ``row_number() <= q``, pruned per task before the shuffle by
    Spark's WindowGroupLimit, so a hot group ships at most q rows per task.
    ``index``: the bucketed per-group index, so no group is one task."""
    name = rank or "_skein_rank"
    if q <= 0:
        out = df.withColumn(name, F.lit(0).cast("bigint")).limit(0)
    elif how == "topk" or (how == "auto" and q <= GROUP_TOP_K_ROWS):
        rn = F.row_number().over(Window.partitionBy(group).orderBy(*order))
        out = df.withColumn(name, rn).filter(F.col(name) <= q).withColumn(name, F.col(name).cast("bigint"))
    else:
        out = global_index(df, order, group, name="_skein_at").filter(F.col("_skein_at") < q) \
            .withColumn(name, F.col("_skein_at") + 1).drop("_skein_at")
    return out if rank else out.drop(name)


def eval_quota(df: DataFrame, source: str, by: Sequence[str], q: int, rank: str | None = None,
               how: str = "auto") -> DataFrame:
    """First ``q`` rows of every source in ``by`` order."""
    return _first_q(df, source, list(by), q, rank, how)


def eval_sample(df: DataFrame, source: str, key: Sequence[str], q: int, seed: int = 42,
                rank: str | None = None, how: str = "auto") -> DataFrame:
    """Per source, a uniform sample of ``q`` rows without replacement
    (all rows when the source has at most q). The draw is the rank of
    md5(seed:sample:source:key), so it does not depend on partitioning."""
    h = hash_long(seed, F.lit("sample"), F.col(source), *[F.col(k) for k in key])
    out = _first_q(df.withColumn("_skein_h", h), source, ["_skein_h", *key], q, rank, how)
    return out.drop("_skein_h")


def eval_set(quotas: DataFrame, source_order: DataFrame, by: Sequence[str], size: int,
             rank: str | None = None) -> DataFrame:
    """Concatenation of per-source quotas in source order, capped to ``size``.

    ``source_order`` is the small mix table (source, src_pos). With ``rank``
    (the quota's per-source rank, in ``by`` order) the cap is exact without a
    global sort: a row is kept when the rows of earlier sources plus its rank
    fit in ``size``; the offsets come from one count per source."""
    so = F.broadcast(source_order.select("source", "src_pos"))     # the mix table: configuration
    if rank is None:
        ranked = global_index(quotas, by, "source", name="_skein_at") \
            .withColumn("_skein_rank", F.col("_skein_at") + 1).drop("_skein_at")
        return eval_set(ranked, source_order, by, size, "_skein_rank").drop("_skein_rank")
    counts = quotas.groupBy("source").agg(F.count(F.lit(1)).alias("_skein_n")).join(so, "source")
    w = Window.partitionBy(F.lit(1)).orderBy("src_pos").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select("source", F.coalesce(F.sum("_skein_n").over(w), F.lit(0)).alias("_skein_off"))
    j = quotas.join(F.broadcast(offs), "source")  # one row per source
    return j.filter(F.col("_skein_off") + F.col(rank) <= size).drop("_skein_off")


def subsample(df: DataFrame, ratio: float, key: Sequence[str], seed: int = 42,
              mode: str = "documented") -> DataFrame:
    """Keep rows with u(seed:key) < ratio ('documented'). 'reference' keeps
    every row and shuffles: ``pos`` is its place in the seeded order (M4)."""
    if mode not in ("documented", "reference"):
        raise ValueError(f"unknown subsample mode {mode!r}")
    if ratio >= 1.0:
        return df
    if mode == "reference":
        from skein.operators.mixing import shuffle_global
        return shuffle_global(df, key, seed)
    return df.filter(hash_uniform(seed, F.lit("subsample"), *[F.col(k) for k in key]) < F.lit(ratio))


def overlap(train: DataFrame, evald: DataFrame, key: Sequence[str]) -> DataFrame:
    """Eval rows that are also training rows (left semi join)."""
    return evald.join(train.select(*key), list(key), "left_semi")


def exclude_eval(train: DataFrame, evald: DataFrame, key: Sequence[str]) -> DataFrame:
    """L9 fix: training rows that are not in the eval set (left anti join)."""
    return train.join(evald.select(*key), list(key), "left_anti")
