"""End-to-end data preparation flows built from the operators.

E1 pretraining: per-source rows -> tokenize/fit/mask -> weighted interleave
until every source is read once -> global shuffle -> take n -> batch plan.
E2 instruction tuning: instruction rows -> template -> cap -> 90/10 tail
split -> tokenize/fit/mask.

Both return lazy DataFrames; the payload (token arrays) is joined to the
integer plan only at the end, so the planning steps shuffle small rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import formatting as P
from skein.operators import mixing as M
from skein.operators import sampling as L
from skein.operators import tokens as T
from skein.session import stored


def prepare_pretraining(spark: SparkSession, data: DataFrame, weights: dict[str, float], vocab: DataFrame,
                        block_size: int, take: int | None = None, batch: int = 8, accum: int = 1,
                        seed: int = 42, text: str = "text",
                        evald: DataFrame | None = None) -> DataFrame:
    """E1. ``data`` = (source, idx, text) with ``idx`` unique per source.
    Rows of the eval set ``evald`` (source, idx) are left out of training (L9).

    Returns (pos, batch, step, source, idx, epoch, input_ids, attention_mask,
    labels, n_tok) for the first ``take`` shuffled positions."""
    if evald is not None:
        data = L.exclude_eval(data, evald, ["source", "idx"])
    keys = data.select("source", "idx")
    plan = M.interleave(spark, keys, weights, ["idx"], seed, "all_exhausted")
    plan = M.shuffle_global(plan.select("k", "source", "idx", "epoch"), ["k"], seed, name="pos")
    if take is not None:
        plan = plan.filter(F.col("pos") < take)
    plan = stored(plan, "mix-plan")                # the integer plan: read by the steps below, not recomputed
    plan = plan.withColumn("batch", F.floor(F.col("pos") / batch).cast("bigint")) \
               .withColumn("step", F.floor(F.col("batch") / accum).cast("bigint"))
    # Only rows the plan uses are tokenized (semi join on distinct keys), then
    # the payload is attached with the same epoch salting as the interleave,
    # so a tiny, heavily weighted source is not one hot join key.
    used = data.join(plan.select("source", "idx").distinct(), ["source", "idx"], "left_semi")
    fitted = T.tokenize(used, ["source", "idx"], vocab, text, block_size)
    sizes = {r["source"]: int(r["n"]) for r in
             keys.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per source
    salts = M.epoch_salts(plan, {s: n for s, n in sizes.items() if weights.get(s, 1.0) > 0})
    return M.salted_join(plan, fitted, ["source", "idx"], salts)


def prepare_instruction(rows: DataFrame, vocab_from_text: bool = True, vocab_size: int = 4096,
                        block_size: int = 512, max_train: int | None = None, max_eval: int | None = None,
                        by: Sequence[str] = ("row_key",)) -> tuple[DataFrame, DataFrame]:
    """E2. ``rows`` = (row_key, instruction, input, output). Returns
    (fitted rows with split, vocabulary)."""
    formatted = P.format_instruction(rows)
    split = L.tail_split(formatted.select(*by, "text"), list(by), 0.9, max_train, max_eval)
    vocab = T.build_vocab(split, "text", vocab_size)
    fitted = T.tokenize(split, [*by, "split"], vocab, "text", block_size)
    return fitted, vocab
