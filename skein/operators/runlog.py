"""Run-log analytics over (run_id, step, metric, value).

Per-run order statistics use the bucketed global index and associative scans
(running min / max), so a run with a third of all log rows is still spread
over many tasks; top-n per run uses ``row_number() <= n``, which Spark turns
into a per-task WindowGroupLimit before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ordering import drop_bucket, global_index, scan, scans


def drop_nonfinite(metrics: DataFrame, value: str = "value") -> DataFrame:
    """drop NaN and +/-Infinity values."""
    v = F.col(value)
    return metrics.filter(~F.isnan(v) & (F.abs(v) != F.lit(float("inf"))) & v.isNotNull())


def nonfinite_report(metrics: DataFrame, run: str = "run_id", value: str = "value") -> DataFrame:
    """F4 counts: kept and dropped rows per run."""
    v = F.col(value)
    bad = F.isnan(v) | (F.abs(v) == F.lit(float("inf"))) | v.isNull()
    return metrics.groupBy(run).agg(F.count_if(~bad).alias("n_kept"), F.count_if(bad).alias("n_dropped"))


def cadence(metrics: DataFrame, every: int, first: bool = True, run: str = "run_id",
            step: str = "step") -> DataFrame:
    """rows at ``step % every == 0``, plus each run's first step (its
    position 0 in the bucketed per-run index, so a hot run is never one task
    or one join key)."""
    keep = (F.col(step) % every) == 0
    if first:
        ix = global_index(metrics, [step], run, name="_skein_pos")
        return ix.filter(keep | (F.col("_skein_pos") == 0)).drop("_skein_pos")
    return metrics.filter(keep)


def best_checkpoint(metrics: DataFrame, greater: bool = False, run: str = "run_id",
                    step: str = "step", value: str = "value") -> DataFrame:
    """Best step per run (lowest value, or highest with ``greater``);
    ties go to the earliest step."""
    v = -F.col(value) if greater else F.col(value)
    return metrics.groupBy(run).agg(
        F.min_by(F.col(step), F.struct(v, F.col(step))).alias("best_step"),
        F.min_by(F.col(value), F.struct(v, F.col(step))).alias("best_value"))


def retain(ckpts: DataFrame, n: int, best: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """R2: the last ``n`` checkpoints of every run, plus its best one."""
    rn = F.row_number().over(Window.partitionBy(run).orderBy(F.col(step).desc()))
    recent = ckpts.select(run, step).withColumn("_skein_rn", rn).filter(F.col("_skein_rn") <= n) \
                  .select(run, step, F.lit(True).alias("is_recent"))
    b = best.select(run, F.col("best_step").alias(step), F.lit(True).alias("is_best"))
    j = recent.join(b, [run, step], "full")
    return j.select(run, step, F.coalesce("is_recent", F.lit(False)).alias("is_recent"),
                    F.coalesce("is_best", F.lit(False)).alias("is_best"))


def early_stop(metrics: DataFrame, patience: int, threshold: float = 0.0, greater: bool = False,
               run: str = "run_id", step: str = "step", value: str = "value") -> DataFrame:
    """Per run, the eval at which ``patience`` consecutive evals have not
    improved on the best earlier value by more than ``threshold``.

    stop_step is NULL when the run never triggers the rule."""
    v = -F.col(value) if greater else F.col(value)
    r = scans(metrics.withColumn("_skein_v", v),
              [("_skein_rank", F.lit(1).cast("bigint"), "sum", False), ("_skein_best", F.col("_skein_v"), "min", False)],
              [step], run, keep_bucket=True)
    improved = F.col("_skein_best").isNull() | ((F.col("_skein_best") - F.col("_skein_v")) > F.lit(threshold))
    r = r.withColumn("_skein_imp", F.when(improved, F.col("_skein_rank")))
    r = scan(r, "_skein_imp", [step], run, name="_skein_last", how="max", inclusive=True)
    r = drop_bucket(r).withColumn("_skein_gap", F.col("_skein_rank") - F.col("_skein_last"))
    trig = F.when(F.col("_skein_gap") >= patience, F.col("_skein_rank"))
    return r.groupBy(run).agg(F.min_by(F.col(step), trig).alias("stop_step"),
                              (F.min(trig) + 1).alias("stop_eval"),
                              F.count(F.lit(1)).alias("n_evals"))


def latest_checkpoint(ckpts: DataFrame, run: str = "run_id", step: str = "step") -> DataFrame:
    """The latest step per run (resume point)."""
    return ckpts.groupBy(run).agg(F.max(step).alias("latest_step"))
