"""Derived inputs: driver tables -> the shapes the operators take.

Each derivation has a Spark builder and the same definition as a DuckDB CTE so
oracle SQL can start from identical rows.

* instruction rows: a user turn and the assistant turn right after it; the
  conversation's system turn (if any) is the ``input``.
* sources: ``documents.lang`` is the mix source; ``doc_id`` the row order.
* pred rows: ``embeddings`` as 64 logits per token, ``seq_id = vec_id div 8``,
  ``pos = vec_id % 8``, label -100 where ``vec_id % 5 = 0``.
* steplog: ``events`` per ``user_id`` ordered by (ts, event_id).
* run_metrics: ``events`` as a loss curve per ``user_id``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.plans.registry import load

ROW_KEY_TURNS = 1_000_000  # turns per conversation assumed below this in row_key


def instruction_rows(spark: SparkSession, sf: str) -> DataFrame:
    conv = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    u = conv.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("instruction"))
    a = conv.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("output"))
    s = conv.filter(F.col("role") == "system").groupBy("conv_id").agg(
        F.min_by("text", "turn").alias("input"))
    pairs = u.join(a, ["conv_id", "turn"]).join(s, "conv_id", "left")
    return pairs.select((F.col("conv_id") * ROW_KEY_TURNS + F.col("turn")).alias("row_key"),
                        "conv_id", "turn", "instruction", "input", "output")


INSTRUCTION_SQL = f"""
inst AS (
  SELECT u.conv_id * {ROW_KEY_TURNS} + u.turn AS row_key, u.conv_id, u.turn, u.text AS instruction,
         s.input, a.text AS output
  FROM conversations u
  JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS input FROM conversations WHERE role = 'system'
             GROUP BY conv_id) s ON s.conv_id = u.conv_id
  WHERE u.role = 'user')"""


def sources(spark: SparkSession, sf: str) -> DataFrame:
    """(source, idx, doc_id, text): one source per language, idx = doc_id."""
    d = load(spark, sf, "documents").select("doc_id", "lang", "text")
    return d.select(F.col("lang").alias("source"), F.col("doc_id").alias("idx"), "doc_id", "text")


def pred_rows(spark: SparkSession, sf: str) -> DataFrame:
    e = load(spark, sf, "embeddings").select("vec_id", "embedding", "label")
    return e.select(
        F.floor(F.col("vec_id") / 8).cast("bigint").alias("seq_id"),
        (F.col("vec_id") % 8).cast("int").alias("pos"),
        F.when(F.col("vec_id") % 5 == 0, F.lit(-100)).otherwise(F.col("label")).cast("int").alias("label"),
        F.col("embedding").cast("array<double>").alias("logits"))


PRED_SQL = """
pred AS (
  SELECT CAST(floor(vec_id / 8) AS BIGINT) AS seq_id, CAST(vec_id % 8 AS INTEGER) AS pos,
         CAST(CASE WHEN vec_id % 5 = 0 THEN -100 ELSE label END AS INTEGER) AS label,
         CAST(embedding AS DOUBLE[]) AS logits
  FROM embeddings)"""


def steplog(spark: SparkSession, sf: str) -> DataFrame:
    """(seq_id, ts, event_id, q_halt, q_continue): one row per halting step.

    The step number itself is a per-sequence rank, computed by the operators.
    """
    ev = load(spark, sf, "events").select("event_id", "ts", "user_id", "value")
    return ev.select(
        F.col("user_id").alias("seq_id"), "ts", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"), "event_id",
        F.round(F.col("value") / 10.0 - 1.0, 4).alias("q_halt"),
        F.round((F.col("event_id") % 7) / 3.0 - 1.0, 4).alias("q_continue"))


STEPLOG_SQL = """
steplog AS (
  SELECT user_id AS seq_id, ts, event_id, round(value / 10.0 - 1.0, 4) AS q_halt,
         round((event_id % 7) / 3.0 - 1.0, 4) AS q_continue
  FROM events)"""


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """(run_id, step, metric, value): each user's events are one run's eval log.

    step = event_id (unique, increasing with time); metric 'eval_loss';
    value = events.value / 100 (a loss-sized number).
    """
    ev = load(spark, sf, "events").select("event_id", "user_id", "value")
    return ev.select(F.col("user_id").cast("string").alias("run_id"), F.col("event_id").alias("step"),
                     F.lit("eval_loss").alias("metric"), (F.col("value") / 100.0).alias("value"))


RUN_METRICS_SQL = """
run_metrics AS (
  SELECT CAST(user_id AS VARCHAR) AS run_id, event_id AS step, 'eval_loss' AS metric,
         value / CAST(100 AS DOUBLE) AS value FROM events)"""


def gappy_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """run_metrics with NaN, infinite and missing values among them."""
    v = F.when(F.col("step") % 11 == 0, F.lit(float("nan"))).when(F.col("step") % 13 == 0, F.lit(float("inf"))) \
        .when(F.col("step") % 17 == 0, F.lit(float("-inf"))).when(F.col("step") % 19 != 0, F.col("value"))
    return run_metrics(spark, sf).withColumn("value", v)


GAPPY_METRICS_SQL = f"""{RUN_METRICS_SQL},
gappy AS (SELECT run_id, step, metric, CASE WHEN step % 11 = 0 THEN 'nan'::DOUBLE WHEN step % 13 = 0 THEN 'inf'::DOUBLE
          WHEN step % 17 = 0 THEN '-inf'::DOUBLE WHEN step % 19 <> 0 THEN value END AS value FROM run_metrics)"""


def sql_key(seed, *exprs: str) -> str:
    parts = ", ".join([f"'{seed}'"] + [f"CAST({e} AS VARCHAR)" for e in exprs])
    return f"concat_ws(':', {parts})"


def sql_hash_uniform(seed, *exprs: str) -> str:
    """DuckDB twin of skein.functions.hashing.hash_uniform."""
    return (f"(CAST(CAST(('0x' || substr(md5({sql_key(seed, *exprs)}), 1, 8)) AS BIGINT) AS DOUBLE)"
            f" / CAST(4294967296 AS DOUBLE))")


def sql_hash_long(seed, *exprs: str) -> str:
    """DuckDB twin of skein.functions.hashing.hash_long."""
    return f"CAST(('0x' || substr(md5({sql_key(seed, *exprs)}), 1, 15)) AS BIGINT)"
