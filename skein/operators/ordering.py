"""Positions and running sums over a whole table without a single-task window.

``row_number().over(Window.orderBy(k))`` moves every row into one task. Here
the ordering key is cut into range buckets whose bounds are approximate
quantiles, collected once as literals (so two evaluations of the plan see the
same buckets). Row numbers / running sums are computed per bucket in parallel
and shifted by the running total of the bucket sizes, a table with one row
per bucket. The result equals the single-task window exactly; only the
bucketing is approximate, which affects balance, not values.

The leading ordering column must be numeric; put a unique tie-breaker last.
NULL keys sort first (a bucket of their own before all others) and NULL is a
partition like any other. Rows that tie on the leading column share a bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.session import shuffle_partitions

_B = "_skein_bucket"
_KD = "_skein_key_d"
NULL_BUCKET = -1


def _cols(x) -> list:
    if x is None:
        return []
    if isinstance(x, (str, Column)):
        return [x]
    return list(x)


def _name(c) -> str:
    return c if isinstance(c, str) else None


def range_buckets(df: DataFrame, key: str, buckets: int | None = None,
                  rel_err: float | None = None) -> DataFrame:
    """Add ``_skein_bucket``: a monotone range bucket of numeric ``key``.

    Bounds are approximate quantiles (one pass, bounded sketch); the list of
    bounds is small (``buckets`` values) and becomes a literal of the plan.
    Rows are assigned by binary search (Bucketizer), O(log buckets) per row.
    """
    n = buckets or 4 * shuffle_partitions(df.sparkSession)
    if n <= 1:
        return df.withColumn(_B, F.lit(0).cast("int"))
    rel_err = rel_err if rel_err is not None else 1.0 / (4.0 * n)
    probs = [i / n for i in range(1, n)]
    with_d = df.withColumn(_KD, F.col(key).cast("double"))
    qs = with_d.approxQuantile(_KD, probs, rel_err)
    inner = sorted({q for q in qs if q is not None})
    splits = [float("-inf")] + inner + [float("inf")]
    if len(splits) < 3:
        return df.withColumn(_B, F.lit(0).cast("int"))
    bk = Bucketizer(splits=splits, inputCol=_KD, outputCol=_B, handleInvalid="keep")
    bucket = F.when(F.col(_KD).isNull(), F.lit(NULL_BUCKET)).otherwise(F.col(_B).cast("int"))
    return bk.transform(with_d).withColumn(_B, bucket).drop(_KD)


def equal_buckets(df: DataFrame, key: str, span: int, buckets: int | None = None) -> DataFrame:
    """``range_buckets`` for a key spread evenly over [0, span), such as a hash
    or a position: the bounds are arithmetic, so no quantile pass runs."""
    n = max(1, buckets or 4 * shuffle_partitions(df.sparkSession))
    width = max(1, -(-int(span) // n))
    bucket = F.floor(F.col(key) / F.lit(width)).cast("int")
    return df.withColumn(_B, F.when(F.col(key).isNull(), F.lit(NULL_BUCKET)).otherwise(bucket))


_AGG = {"sum": F.sum, "max": F.max, "min": F.min}


def _shift_table(bucketed: DataFrame, parts: list, value: Column | None, how: str = "sum") -> DataFrame:
    """One row per (parts, bucket): the aggregate of all earlier buckets.

    ``value=None`` counts rows. Only associative aggregates are allowed."""
    agg = F.count(F.lit(1)) if value is None else _AGG[how](value)
    sizes = bucketed.groupBy(*parts, _B).agg(agg.alias("_skein_size"))
    w = Window.partitionBy(*parts).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    prev = _AGG[how]("_skein_size").over(w)
    if how == "sum" or value is None:
        prev = F.coalesce(prev, F.lit(0))
    return sizes.select(*parts, _B, prev.alias("_skein_shift"))


def _with_shift(bucketed: DataFrame, shift: DataFrame, parts: list) -> DataFrame:
    """Attach each row's bucket shift; NULL partitions match NULL."""
    keys = [*parts, _B]
    right = shift.select(*[F.col(k).alias(f"_skein_j{i}") for i, k in enumerate(keys)], "_skein_shift")
    cond = None
    for i, k in enumerate(keys):
        eq = F.col(k).eqNullSafe(F.col(f"_skein_j{i}"))
        cond = eq if cond is None else cond & eq
    return bucketed.join(right, cond).drop(*[f"_skein_j{i}" for i in range(len(keys))])


def _bucketed(df: DataFrame, key: str, buckets: int | None) -> tuple[DataFrame, bool]:
    """Reuse a bucket column left by an earlier step of a chain (its bounds are
    monotone in this step's order too), else cut new range buckets."""
    if _B in df.columns:
        return df, True
    return range_buckets(df, key, buckets), False


def drop_bucket(df: DataFrame) -> DataFrame:
    return df.drop(_B)


def global_index(df: DataFrame, order: Sequence | str, partition: Sequence | str | None = None,
                 name: str = "idx", buckets: int | None = None, keep_bucket: bool = False) -> DataFrame:
    """0-based position of each row in ``order`` (within ``partition``).

    ``keep_bucket=True`` leaves the bucket column for a following scan in a
    monotone order, which then reuses the same partitioning (no new exchange
    and no new quantile pass)."""
    order, parts = _cols(order), _cols(partition)
    b, reused = _bucketed(df, _name(order[0]), buckets)
    shift = _shift_table(b, parts, None)
    rn = F.row_number().over(Window.partitionBy(*parts, _B).orderBy(*order))
    out = _with_shift(b.withColumn("_skein_rowno", rn), shift, parts)
    out = out.withColumn(name, (F.col("_skein_shift") + F.col("_skein_rowno") - 1).cast("bigint")) \
             .drop("_skein_rowno", "_skein_shift")
    return out if (keep_bucket or reused) else out.drop(_B)


def scans(df: DataFrame, specs: Sequence[tuple[str, Column, str, bool]], order: Sequence | str,
          partition: Sequence | str | None = None, buckets: int | None = None,
          keep_bucket: bool = False) -> DataFrame:
    """Several running aggregates (name, value, how, inclusive) in one order:
    one window pass, one aggregate per bucket and one shift join for all."""
    order, parts = _cols(order), _cols(partition)
    b, reused = _bucketed(df, _name(order[0]), buckets)
    sizes = b.groupBy(*parts, _B).agg(*[_AGG[how](v).alias(f"_skein_a{i}") for i, (_, v, how, _) in enumerate(specs)])
    before = Window.partitionBy(*parts).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    shift = sizes.select(*parts, _B, F.struct(*[_AGG[how](f"_skein_a{i}").over(before).alias(f"s{i}")
                                                for i, (_, _, how, _) in enumerate(specs)]).alias("_skein_shift"))
    out = b
    for i, (_, v, how, inclusive) in enumerate(specs):
        w = Window.partitionBy(*parts, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = out.withColumn(f"_skein_r{i}", _AGG[how](v).over(w))
    out = _with_shift(out, shift, parts)
    for i, (name, _, how, _) in enumerate(specs):
        old, run = F.col("_skein_shift")[f"s{i}"], F.col(f"_skein_r{i}")
        if how == "sum":
            res = F.coalesce(old, F.lit(0)) + F.coalesce(run, F.lit(0))
        else:
            res = F.greatest(old, run) if how == "max" else F.least(old, run)
        out = out.withColumn(name, res)
    out = out.drop("_skein_shift", *[f"_skein_r{i}" for i in range(len(specs))])
    return out if (keep_bucket or reused) else out.drop(_B)


def prefix_sum(df: DataFrame, value: str | Column, order: Sequence | str,
               partition: Sequence | str | None = None, name: str = "cum",
               inclusive: bool = True, buckets: int | None = None,
               bounded_groups: bool = False) -> DataFrame:
    """Running sum of ``value`` in ``order`` (within ``partition``).

    ``bounded_groups=True`` says every partition group is small (e.g. a pack
    group of 1000 rows), so a plain partitioned window is used.
    """
    out = scan(df, value, order, partition, name, "sum", inclusive, buckets, bounded_groups)
    return out.withColumn(name, F.col(name).cast("bigint"))


def scan(df: DataFrame, value: str | Column, order: Sequence | str,
         partition: Sequence | str | None = None, name: str = "cum", how: str = "sum",
         inclusive: bool = True, buckets: int | None = None, bounded_groups: bool = False,
         keep_bucket: bool = False) -> DataFrame:
    """Running ``how`` (sum, max, min) of ``value``; exclusive scans of an
    empty prefix give 0 for sum and NULL for max/min."""
    order, parts = _cols(order), _cols(partition)
    v = F.col(value) if isinstance(value, str) else value
    fn = _AGG[how]
    frame_end = 0 if inclusive else -1
    if bounded_groups and parts:
        w = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
        r = fn(v).over(w)
        return df.withColumn(name, F.coalesce(r, F.lit(0)) if how == "sum" else r)
    b, reused = _bucketed(df, _name(order[0]), buckets)
    shift = _shift_table(b, parts, v, how)
    w = Window.partitionBy(*parts, _B).orderBy(*order).rowsBetween(Window.unboundedPreceding, frame_end)
    out = _with_shift(b.withColumn("_skein_run", fn(v).over(w)), shift, parts)
    if how == "sum":
        res = F.col("_skein_shift") + F.coalesce(F.col("_skein_run"), F.lit(0))
    elif how == "max":
        res = F.greatest(F.col("_skein_shift"), F.col("_skein_run"))
    else:
        res = F.least(F.col("_skein_shift"), F.col("_skein_run"))
    out = out.withColumn(name, res).drop("_skein_run", "_skein_shift")
    return out if (keep_bucket or reused) else out.drop(_B)
