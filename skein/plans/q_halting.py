"""Queries for the halting rules over the step log."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import halting as W
from skein.plans.derive import STEPLOG_SQL, sql_hash_uniform, steplog
from skein.plans.registry import register

MAXS = W.MAX_STEPS
ORDER = ["ts_us", "event_id"]


def halting_sql(training: bool = True) -> str:
    """CTEs r, l, h, tg, hs: the halting rules on the step log in DuckDB."""
    if training:
        step = f"CAST(((rank - last_sig - 1) % {MAXS}) + 1 AS INTEGER)"
        halted = f"step >= {MAXS} OR q_halt > q_continue"
    else:
        step = f"CAST(((rank - 1) % {MAXS}) + 1 AS INTEGER)"
        halted = f"step >= {MAXS}"
    return f"""{STEPLOG_SQL},
r AS (SELECT seq_id, event_id, q_halt, q_continue,
             row_number() OVER (PARTITION BY seq_id ORDER BY ts, event_id) AS rank FROM steplog),
l AS (SELECT *, coalesce(max(CASE WHEN q_halt > q_continue THEN rank END)
                  OVER (PARTITION BY seq_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  AS last_sig FROM r),
st AS (SELECT *, {step} AS step FROM l),
h AS (SELECT *, ({halted}) AS halted FROM st),
tg AS (SELECT h.*, 1.0 / (1.0 + exp(-(CASE WHEN h.step >= {MAXS} THEN n.q_halt
                                       ELSE greatest(n.q_halt, n.q_continue) END))) AS target_q_continue
       FROM h LEFT JOIN h n ON n.seq_id = h.seq_id AND n.rank = h.rank + 1),
fh AS (SELECT seq_id, min(rank) FILTER (WHERE halted) AS first_halt, max(rank) AS last_rank FROM tg GROUP BY seq_id),
hs AS (SELECT tg.seq_id, fh.first_halt IS NOT NULL AS halted, tg.step AS steps, tg.q_halt, tg.q_continue,
              tg.target_q_continue
       FROM tg JOIN fh ON tg.seq_id = fh.seq_id AND tg.rank = coalesce(fh.first_halt, fh.last_rank))"""


def _steps(spark, sf, training=True):
    return W.halt_steps(steplog(spark, sf), ORDER, MAXS, training)


def halt_steps_train(spark, sf):
    return _steps(spark, sf, True).select("seq_id", "event_id", "rank", "step", "halted")


register("halt_steps_train", f"""
WITH {halting_sql(True)}
SELECT seq_id, event_id, CAST(rank AS BIGINT) AS rank, step, halted FROM h
""")(halt_steps_train)


def halt_steps_eval(spark, sf):
    return _steps(spark, sf, False).select("seq_id", "event_id", "rank", "step", "halted")


register("halt_steps_eval", f"""
WITH {halting_sql(False)}
SELECT seq_id, event_id, CAST(rank AS BIGINT) AS rank, step, halted FROM h
""")(halt_steps_eval)


def halt_targets_q(spark, sf):
    t = W.halt_targets(_steps(spark, sf, True), MAXS)
    return t.select("seq_id", "event_id", F.round("target_q_continue", 6).alias("target_q_continue"))


register("halt_targets", f"""
WITH {halting_sql(True)}
SELECT seq_id, event_id, round(target_q_continue, 6) AS target_q_continue FROM tg
""")(halt_targets_q)


def steps_histogram_q(spark, sf):
    return W.steps_histogram(W.halt_state(_steps(spark, sf, True)))


register("steps_histogram", f"""
WITH {halting_sql(True)}
SELECT steps, count(*) AS n_seqs FROM hs WHERE halted GROUP BY steps
""")(steps_histogram_q)


def halt_state_q(spark, sf):
    state = W.halt_state(W.halt_targets(_steps(spark, sf, True), MAXS))
    return state.select("seq_id", "halted", "steps", "q_halt", "q_continue",
                        F.round("target_q_continue", 6).alias("target_q_continue"))


register("halt_state", f"""
WITH {halting_sql(True)}
SELECT seq_id, halted, steps, q_halt, q_continue, round(target_q_continue, 6) AS target_q_continue FROM hs
""")(halt_state_q)


def halt_steps_explore_q(spark, sf):
    """W2 with exploration (p = 0.1): the full training rule."""
    return W.halt_steps_explore(steplog(spark, sf), ORDER, MAXS, W.EXPLORE_P, 42).select(
        "seq_id", "event_id", "rank", "step", "halted")


def _explore_sql() -> str:
    u = sql_hash_uniform(42, "'a'", "seq_id", "rank")
    k = f"(2 + CAST(floor({sql_hash_uniform(42, chr(39) + 'b' + chr(39), 'seq_id', 'rank')} * {MAXS - 1}) AS INTEGER))"
    return f"""
WITH RECURSIVE {STEPLOG_SQL},
r AS (SELECT seq_id, event_id, q_halt > q_continue AS sig,
             row_number() OVER (PARTITION BY seq_id ORDER BY ts, event_id) AS rank FROM steplog),
b AS (SELECT *, CASE WHEN {u} < 0.1 THEN {k} ELSE 0 END AS mn FROM r),
rec AS (
  SELECT seq_id, rank, event_id, 1 AS step, (1 >= {MAXS} OR (sig AND 1 >= mn)) AS halted FROM b WHERE rank = 1
  UNION ALL
  SELECT b.seq_id, b.rank, b.event_id, CASE WHEN rec.halted THEN 1 ELSE rec.step + 1 END,
         (CASE WHEN rec.halted THEN 1 ELSE rec.step + 1 END) >= {MAXS}
           OR (b.sig AND (CASE WHEN rec.halted THEN 1 ELSE rec.step + 1 END) >= b.mn)
  FROM rec JOIN b ON b.seq_id = rec.seq_id AND b.rank = rec.rank + 1)
SELECT seq_id, event_id, CAST(rank AS BIGINT) AS rank, CAST(step AS INTEGER) AS step, halted FROM rec
"""


register("halt_steps_explore", _explore_sql())(halt_steps_explore_q)
