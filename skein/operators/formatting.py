"""Formatting and projection operators.

All are column expressions: they run inside the scan's codegen stage with no
shuffle. Only P2 (conversation -> text) groups, because its output is one row
per conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------
# Instruction template, with and without the input block, and the prompt wrap.
INSTRUCTION_HEAD = "### Instruction:\n"
INPUT_HEAD = "\n\n### Input:\n"
RESPONSE_HEAD = "\n\n### Response:\n"
PROMPT_MARK = "###"
# Text column probe order (first present wins).
TEXT_COLUMNS = ("text", "content", "code", "instruction", "output")
# Separator of instruction and output in the combine mode.
COMBINE_SEP = "\n\n"
ELLIPSIS = "..."
# ----------------------------------------------------------------------------


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def instruction_text(instruction, output, inp=None) -> Column:
    """P1 as a column. The input block is used when input is non-NULL and
    non-empty; whitespace-only input counts as present (reference truthiness).
    NULL instruction/output become '' instead of failing the row."""
    i = F.coalesce(_c(instruction), F.lit(""))
    o = F.coalesce(_c(output), F.lit(""))
    short = F.concat(F.lit(INSTRUCTION_HEAD), i, F.lit(RESPONSE_HEAD), o)
    if inp is None:
        return short
    x = _c(inp)
    full = F.concat(F.lit(INSTRUCTION_HEAD), i, F.lit(INPUT_HEAD), x, F.lit(RESPONSE_HEAD), o)
    return F.when(x.isNotNull() & (x != F.lit("")), full).otherwise(short)


def format_instruction(df: DataFrame, instruction: str = "instruction", inp: str = "input",
                       output: str = "output", out: str = "text") -> DataFrame:
    """Add ``out`` with the instruction template; a missing input column
    means the short form for every row."""
    x = inp if inp in df.columns else None
    return df.withColumn(out, instruction_text(instruction, output, x))


def capitalize(c) -> Column:
    """First character upper, the rest lower (Python ``str.capitalize``)."""
    c = _c(c)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def format_conversation(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                        text: str = "text", out: str = "text") -> DataFrame:
    """One row per conversation, 'Role: content' lines joined by newline.

    The turns of a conversation become one output string, so they meet in one
    row by definition; partial aggregation is not possible for a string concat.
    """
    g = df.groupBy(conv).agg(F.array_sort(F.collect_list(
        F.struct(F.col(turn).alias("t"), capitalize(role).alias("r"), F.coalesce(_c(text), F.lit("")).alias("x"))
    )).alias("_turns"))
    lines = F.transform("_turns", lambda s: F.concat(s["r"], F.lit(": "), s["x"]))
    return g.select(conv, F.array_join(lines, "\n").alias(out), F.size("_turns").alias("n_turns"))


def wrap_prompt(p) -> Column:
    """Bare prompts get the instruction/response frame; framed ones stay."""
    p = _c(p)
    return F.when(p.startswith(PROMPT_MARK), p).otherwise(
        F.concat(F.lit(INSTRUCTION_HEAD), p, F.lit(RESPONSE_HEAD)))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    """drop rows whose text is NULL or only whitespace."""
    return df.filter(F.col(col).rlike(r"\S"))


def resolve_text(df: DataFrame, mode: str = "reference", out: str = "text") -> DataFrame:
    """Pick the text column by name at plan time.

    reference: first of text, content, code, instruction, output; so with an
    instruction column the output is silently dropped (as the reference does).
    combine: if both instruction and output exist (and no text/content/code),
    text = instruction + blank line + output.
    No candidate -> ValueError listing the columns.
    """
    cols = set(df.columns)
    if mode == "combine" and {"instruction", "output"} <= cols and not cols & {"text", "content", "code"}:
        t = F.concat(F.coalesce(F.col("instruction"), F.lit("")), F.lit(COMBINE_SEP),
                     F.coalesce(F.col("output"), F.lit("")))
        return df.withColumn(out, t)
    for name in TEXT_COLUMNS:
        if name in cols:
            return df.withColumn(out, F.col(name)) if name != out else df
    raise ValueError(f"none of {list(TEXT_COLUMNS)} is a column of {sorted(df.columns)}")


def preview(c, n: int, always: bool = False) -> Column:
    """First ``n`` characters plus '...' (always, or only when longer)."""
    c = _c(c)
    head = F.substring(c, 1, n)
    if always:
        return F.concat(head, F.lit(ELLIPSIS))
    return F.concat(head, F.when(F.length(c) > n, F.lit(ELLIPSIS)).otherwise(F.lit("")))
