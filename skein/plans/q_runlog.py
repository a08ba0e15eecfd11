"""Queries for run-log analytics."""

from __future__ import annotations


from skein.operators import runlog as R
from skein.plans.derive import GAPPY_METRICS_SQL, RUN_METRICS_SQL, gappy_metrics, run_metrics
from skein.plans.registry import register

PATIENCE = 5
KEEP = 3
EVERY = 10


def best_checkpoint_q(spark, sf):
    return R.best_checkpoint(run_metrics(spark, sf))


register("best_checkpoint", f"""
WITH {RUN_METRICS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY value, step) AS rn FROM run_metrics)
SELECT run_id, step AS best_step, value AS best_value FROM r WHERE rn = 1
""")(best_checkpoint_q)


def retention(spark, sf):
    m = run_metrics(spark, sf)
    return R.retain(m, KEEP, R.best_checkpoint(m))


register("retention", f"""
WITH {RUN_METRICS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step DESC) AS rd,
             row_number() OVER (PARTITION BY run_id ORDER BY value, step) AS rb FROM run_metrics)
SELECT run_id, step, rd <= {KEEP} AS is_recent, rb = 1 AS is_best FROM r WHERE rd <= {KEEP} OR rb = 1
""")(retention)


def early_stop_q(spark, sf):
    return R.early_stop(run_metrics(spark, sf), PATIENCE, 0.0)


register("early_stop", f"""
WITH {RUN_METRICS_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY step) - 1 AS rk,
             min(value) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
               AS best FROM run_metrics),
i AS (SELECT *, max(CASE WHEN best IS NULL OR best - value > 0.0 THEN rk END)
                  OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_imp
      FROM r)
SELECT run_id, arg_min(step, CASE WHEN rk - last_imp >= {PATIENCE} THEN rk END) AS stop_step,
       min(CASE WHEN rk - last_imp >= {PATIENCE} THEN rk END) + 1 AS stop_eval, count(*) AS n_evals
FROM i GROUP BY run_id
""")(early_stop_q)


def metric_cadence(spark, sf):
    return R.cadence(run_metrics(spark, sf), EVERY, True).select("run_id", "step", "value")


register("metric_cadence", f"""
WITH {RUN_METRICS_SQL},
f AS (SELECT run_id, min(step) AS first_step FROM run_metrics GROUP BY run_id)
SELECT m.run_id, m.step, m.value FROM run_metrics m JOIN f ON m.run_id = f.run_id
WHERE m.step % {EVERY} = 0 OR m.step = f.first_step
""")(metric_cadence)


def nan_filter(spark, sf):
    return R.nonfinite_report(gappy_metrics(spark, sf))


register("nan_filter", f"""
WITH {GAPPY_METRICS_SQL}
SELECT run_id, count(*) FILTER (WHERE isfinite(value)) AS n_kept,
       count(*) FILTER (WHERE NOT isfinite(value) OR value IS NULL) AS n_dropped
FROM gappy GROUP BY run_id
""")(nan_filter)


def latest_checkpoint_q(spark, sf):
    return R.latest_checkpoint(R.drop_nonfinite(gappy_metrics(spark, sf)))


register("latest_checkpoint", f"""
WITH {GAPPY_METRICS_SQL}
SELECT run_id, max(step) AS latest_step FROM gappy WHERE isfinite(value) GROUP BY run_id
""")(latest_checkpoint_q)
