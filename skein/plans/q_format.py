"""Queries for formatting and text projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import formatting as P
from skein.plans.derive import INSTRUCTION_SQL, instruction_rows
from skein.plans.registry import load, register

_NL = "chr(10)"


def format_instruction_q(spark, sf):
    rows = P.format_instruction(instruction_rows(spark, sf))
    return rows.select("row_key", "text", (F.col("input").isNotNull() & (F.col("input") != "")).alias("has_input"))


register("format_instruction", f"""
WITH {INSTRUCTION_SQL}
SELECT row_key,
       CASE WHEN input IS NOT NULL AND input <> ''
            THEN '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Input:' || {_NL} || input
                 || {_NL} || {_NL} || '### Response:' || {_NL} || output
            ELSE '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Response:' || {_NL} || output
       END AS text,
       (input IS NOT NULL AND input <> '') AS has_input
FROM inst
""")(format_instruction_q)


def format_conversation_q(spark, sf):
    conv = load(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return P.format_conversation(conv)


register("format_conversation", f"""
SELECT conv_id,
       string_agg(upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text, {_NL} ORDER BY turn) AS text,
       CAST(count(*) AS INTEGER) AS n_turns
FROM conversations GROUP BY conv_id
""")(format_conversation_q)


def wrap_prompt_q(spark, sf):
    """Prompts: benchmark items (bare) and formatted instructions (already framed),
    and benchmark items with blank and missing ones among them; blank ones
    dropped, then wrapped."""
    bench = load(spark, sf, "benchmark").select(F.lit("benchmark").alias("kind"),
                                                F.col("item_id").alias("id"), F.col("text").alias("prompt"))
    inst = P.format_instruction(instruction_rows(spark, sf)).select(
        F.lit("instruction").alias("kind"), F.col("row_key").alias("id"), F.col("text").alias("prompt"))
    blank = bench.select(F.lit("gappy").alias("kind"), "id", F.when(F.col("id") % 4 == 0, "")
                         .when(F.col("id") % 4 == 1, " \n\t").when(F.col("id") % 4 == 3, F.col("prompt")).alias("prompt"))
    prompts = P.drop_blank(bench.unionByName(inst).unionByName(blank), "prompt")
    return prompts.select("kind", "id", P.wrap_prompt("prompt").alias("wrapped"))


register("wrap_prompt", f"""
WITH {INSTRUCTION_SQL},
p AS (
  SELECT 'benchmark' AS kind, item_id AS id, text AS prompt FROM benchmark
  UNION ALL
  SELECT 'gappy', item_id, CASE item_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' ' || chr(10) || chr(9) WHEN 3 THEN text END
  FROM benchmark
  UNION ALL
  SELECT 'instruction', row_key,
         CASE WHEN input IS NOT NULL AND input <> ''
              THEN '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Input:' || {_NL} || input
                   || {_NL} || {_NL} || '### Response:' || {_NL} || output
              ELSE '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Response:' || {_NL} || output
         END FROM inst)
SELECT kind, id,
       CASE WHEN starts_with(prompt, '###') THEN prompt
            ELSE '### Instruction:' || {_NL} || prompt || {_NL} || {_NL} || '### Response:' || {_NL} END AS wrapped
FROM p WHERE regexp_matches(prompt, '\\S')
""")(wrap_prompt_q)


def preview_q(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "text")
    return d.select("doc_id", P.preview("text", 100).alias("preview_100"),
                    P.preview("text", 200, always=True).alias("preview_200"))


register("preview", """
SELECT doc_id,
       substr(text, 1, 100) || CASE WHEN length(text) > 100 THEN '...' ELSE '' END AS preview_100,
       substr(text, 1, 200) || '...' AS preview_200
FROM documents
""")(preview_q)


def resolve_text_reference(spark, sf):
    rows = P.resolve_text(instruction_rows(spark, sf), mode="reference")
    return rows.select("row_key", "text")


register("resolve_text_reference", f"""
WITH {INSTRUCTION_SQL}
SELECT row_key, instruction AS text FROM inst
""")(resolve_text_reference)


def resolve_text_combine(spark, sf):
    rows = P.resolve_text(instruction_rows(spark, sf).drop("input"), mode="combine")
    return rows.select("row_key", "text")


register("resolve_text_combine", f"""
WITH {INSTRUCTION_SQL}
SELECT row_key, instruction || {_NL} || {_NL} || output AS text FROM inst
""")(resolve_text_combine)
