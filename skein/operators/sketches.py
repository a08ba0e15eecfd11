"""Mergeable sketches of distinct values, kept as tables.

A theta sketch is a few thousand hashes whatever it has seen; sketches of
parts (a source, a day, a split) are stored once and merged later into the sketch of
the whole, so a new increment costs its own rows only. Estimates come with the bound that
they keep: ``Z`` standard errors of 1 / sqrt(2^lg_k) of the count, for intersections of the
count of the union. Groups are summed in every task before the shuffle, so a hot group
costs one sketch a task.

Cases: NULL values are not counted, NULL groups are a group; a group without values
estimates 0; an empty table gives no groups; up to 2^lg_k values the estimate is exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LG_K = 12
Z = 4.0


def sketch_table(df: DataFrame, by: Sequence[str], value: str | Column, lg_k: int = LG_K) -> DataFrame:
    """(by, n_rows, sketch) of the distinct values in each group."""
    v = F.col(value) if isinstance(value, str) else value
    return df.select(*by, v.alias("_skein_v")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.theta_sketch_agg("_skein_v", lg_k).alias("sketch"))


def merge_sketches(table: DataFrame, by: Sequence[str], lg_k: int = LG_K) -> DataFrame:
    """Sketches of coarser groups, or of a table and its increments (``unionByName``): (by, n_rows, sketch)."""
    return table.groupBy(*by).agg(F.sum("n_rows").alias("n_rows"), F.theta_union_agg("sketch", lg_k).alias("sketch"))


def margin(estimate: Column, lg_k: int = LG_K, z: float = Z) -> Column:
    """Largest error of an estimate that the bound allows."""
    return F.ceil(estimate * F.lit(z / 2 ** (lg_k / 2)))


def estimates(table: DataFrame, lg_k: int = LG_K, z: float = Z) -> DataFrame:
    """The table with estimate and margin in place of the sketch."""
    out = table.withColumn("estimate", F.theta_sketch_estimate("sketch"))
    return out.withColumn("margin", margin(F.col("estimate"), lg_k, z)).drop("sketch")


def overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], lg_k: int = LG_K, z: float = Z) -> DataFrame:
    """L9 from sketches: (by, estimate, margin) of the values that both sides hold, for groups on both sides. NULL
    groups match; each side has one sketch a group."""
    a = left.select(*[F.col(c).alias(f"_a{i}") for i, c in enumerate(by)], F.col("sketch").alias("_sa"))
    b = right.select(*[F.col(c).alias(f"_b{i}") for i, c in enumerate(by)], F.col("sketch").alias("_sb"))
    on = F.lit(True)
    for i in range(len(by)):
        on = on & F.col(f"_a{i}").eqNullSafe(F.col(f"_b{i}"))
    both = a.join(b, on)
    return both.select(*[F.col(f"_a{i}").alias(c) for i, c in enumerate(by)],
                       F.theta_sketch_estimate(F.theta_intersection("_sa", "_sb")).alias("estimate"),
                       margin(F.theta_sketch_estimate(F.theta_union("_sa", "_sb", lg_k)), lg_k, z).alias("margin"))
