"""Scoring and metrics over prediction tables.

Prediction rows are (seq_id, pos, label, logits ARRAY<DOUBLE>). Per-token
scores are array expressions on one row (no shuffle); per-sequence and global
rollups are two-level hash aggregates with map-side partial aggregation, so a
sequence holding a third of all tokens is combined in every task before the
shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.arrays import IGNORE_LABEL, argmax, logsumexp, pick, stablemax_s

LN2 = math.log(2.0)


def valid_tokens(pred: DataFrame, ignore: int = IGNORE_LABEL) -> DataFrame:
    """tokens whose label is not the ignore label."""
    return pred.filter(F.col("label") != ignore)


def nll(logits: Column | str, label: Column | str, kind: str = "softmax",
        ignore: int = IGNORE_LABEL) -> Column:
    """Per-token negative log-likelihood; 0 for ignored tokens."""
    x = F.col(logits) if isinstance(logits, str) else logits
    y = F.col(label) if isinstance(label, str) else label
    if kind == "softmax":
        v = logsumexp(x) - pick(x, y)
    elif kind == "stablemax":
        s = F.transform(x, stablemax_s)
        v = -F.log(pick(s, y) / F.aggregate(s, F.lit(0.0), lambda a, b: a + b))
    else:
        raise ValueError(f"unknown loss {kind!r}")
    return F.when(y != ignore, v).otherwise(F.lit(0.0))


def score_tokens(pred: DataFrame, kind: str = "softmax", ignore: int = IGNORE_LABEL) -> DataFrame:
    """A3 + A6/A7 per token: valid, correct (argmax == label; lowest index wins
    ties), nll."""
    valid = F.col("label") != ignore
    return pred.withColumn("valid", valid) \
               .withColumn("correct", valid & (argmax("logits") == F.col("label"))) \
               .withColumn("nll", nll("logits", "label", kind, ignore))


def score_sequences(tokens: DataFrame) -> DataFrame:
    """A2/A4/A8 per sequence: n_valid, n_correct, exact, divisor, nll sums."""
    g = tokens.groupBy("seq_id").agg(
        F.count_if("valid").alias("n_valid"),
        F.count_if("correct").alias("n_correct"),
        F.sum("nll").alias("nll_sum"))
    div = F.greatest(F.col("n_valid"), F.lit(1))
    return g.withColumn("divisor", div) \
            .withColumn("exact", F.col("n_correct") == F.col("n_valid")) \
            .withColumn("seq_loss", F.col("nll_sum") / div) \
            .withColumn("seq_accuracy", F.col("n_correct") / div)


def bce_with_logits(x: Column, y: Column) -> Column:
    """Numerically stable binary cross-entropy with logits."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))


def is_valid() -> Column:
    """the sequence halted and has at least one valid token."""
    return F.col("halted") & (F.col("n_valid") > 0)


def rollup_scores(seq: DataFrame) -> DataFrame:
    """A5 + A8-A11 in one row. ``seq`` = score_sequences joined with the halt
    state (halted, steps, q_halt, q_continue, target_q_continue).

    Metrics are sums over valid sequences (halted and n_valid > 0), as the
    reference emits them; means divide by ``count``. Losses run over all rows.
    """
    vm = is_valid()
    y = F.col("exact").cast("double")
    halt_loss = bce_with_logits(F.col("q_halt"), y)
    cont_loss = F.when(F.col("target_q_continue").isNotNull(),
                       bce_with_logits(F.col("q_continue"), F.col("target_q_continue")))
    g = seq.agg(
        F.count_if(vm).alias("count"),
        F.sum(F.when(vm, F.col("seq_accuracy")).otherwise(0.0)).alias("accuracy"),
        F.count_if(vm & F.col("exact")).alias("exact_accuracy"),
        F.count_if(vm & ((F.col("q_halt") >= 0) == F.col("exact"))).alias("q_halt_accuracy"),
        F.sum(F.when(vm, F.col("steps")).otherwise(0)).cast("bigint").alias("steps"),
        F.sum("seq_loss").alias("lm_loss"),
        (F.sum("nll_sum") / F.greatest(F.sum("n_valid"), F.lit(1))).alias("lm_loss_micro"),
        (F.sum("n_correct") / F.greatest(F.sum("n_valid"), F.lit(1))).alias("token_accuracy"),
        F.sum(halt_loss).alias("q_halt_loss"),
        F.coalesce(F.sum(cont_loss), F.lit(0.0)).alias("q_continue_loss"))
    return g.withColumn("total_loss", F.col("lm_loss") + 0.5 * (F.col("q_halt_loss") + F.col("q_continue_loss"))) \
            .withColumn("accuracy_mean", F.col("accuracy") / F.greatest(F.col("count"), F.lit(1))) \
            .withColumn("exact_accuracy_mean", F.col("exact_accuracy") / F.greatest(F.col("count"), F.lit(1)))


def perplexity(loss: Column) -> Column:
    """exp(loss); overflow gives +Infinity (double semantics)."""
    return F.exp(loss)


def improvement(metrics: DataFrame, run: str = "run_id", step: str = "step", value: str = "value") -> DataFrame:
    """First and last value per run and the relative improvements of the
    loss and of its perplexity. A first loss of 0 gives an infinite improvement,
    or NaN if nothing changed (double semantics)."""
    g = metrics.groupBy(run).agg(F.min_by(value, step).alias("loss_first"),
                                 F.max_by(value, step).alias("loss_last"),
                                 F.count(F.lit(1)).alias("n_evals"))
    a, b = F.col("loss_first"), F.col("loss_last")
    by_zero = (a - b) * F.pow(a, F.lit(-1.0))
    return g.withColumn("loss_improvement", F.when(a == 0, by_zero).otherwise((a - b) / a)) \
            .withColumn("ppl_first", perplexity(a)).withColumn("ppl_last", perplexity(b)) \
            .withColumn("ppl_improvement", F.lit(1.0) - F.exp(b - a))


def split_sizes(df: DataFrame, splits=("train", "validation")) -> DataFrame:
    """A1: rows per split; declared splits with no rows report 0."""
    spark = df.sparkSession
    names = spark.createDataFrame([(s,) for s in splits], "split string")
    counts = df.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))
    return names.join(counts, "split", "full").select("split", F.coalesce("n_rows", F.lit(0)).alias("n_rows"))


def bits_per_byte(nll: DataFrame, docs: DataFrame, by: str) -> DataFrame:
    """nll_sum / ln 2 / UTF-8 bytes, per ``by``. ``nll`` = (by, n_tokens,
    nll_sum), one row per group, for example from ``unigram_nll``."""
    b = docs.groupBy(by).agg(F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"))
    return nll.join(b, by).withColumn("bits_per_byte", F.col("nll_sum") / F.lit(LN2) / F.col("n_bytes"))


def distinct_ids(df: DataFrame, ids: str, by: str | None = None, approx: bool = False) -> DataFrame:
    """Number of distinct ids (exact, or HyperLogLog++ when ``approx``) of
    an id column, or of an id array column, which is exploded first."""
    one = F.explode(ids) if isinstance(df.schema[ids].dataType, T.ArrayType) else F.col(ids)
    ex = df.select(*([by] if by else []), one.alias("_id"))
    agg = F.approx_count_distinct("_id") if approx else F.count_distinct("_id")
    g = ex.groupBy(by) if by else ex.groupBy()
    return g.agg(agg.alias("n_distinct"))


TOKENS_PER_PARAMETER = 20


def mix_report(per: DataFrame, mix: DataFrame, block: int, parameters: int) -> DataFrame:
    """Per source, token share against target weight, unknown and padding
    fractions at the block size, and the token budget of a model with
    ``parameters`` (20 tokens each): the source's part of it by weight, and how
    many times its tokens must be read to fill that part.

    ``per`` = (source, n_rows, n_tokens, n_unk, n_pad), one row per source;
    ``mix`` = (source, weight_norm), configuration."""
    from pyspark.sql import Window
    share = F.col("n_tokens") / F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row per source
    budget = F.lit(float(TOKENS_PER_PARAMETER * parameters)) * F.col("weight_norm")
    return per.join(F.broadcast(mix), "source").select(
        "source", "n_rows", "n_tokens",
        F.round(share, 6).alias("token_share"),
        F.round("weight_norm", 6).alias("weight_norm"),
        F.round(share / F.col("weight_norm"), 6).alias("share_over_weight"),
        F.round(F.col("n_unk") / F.col("n_tokens"), 6).alias("unk_frac"),
        F.round(F.col("n_pad") / (F.col("n_rows") * block), 6).alias("pad_frac"),
        F.round(budget, 3).alias("budget_tokens"),
        F.round(budget / F.col("n_tokens"), 6).alias("budget_epochs"))


def unigram_nll(counts: DataFrame, by: str) -> DataFrame:
    """Per group, the negative log-likelihood of its tokens under the corpus
    unigram model: sum_t c_gt * (ln N - ln n_t). ``counts`` = token_counts
    (by, token, c). N is the total over the small per-group table, so no
    driver round trip and no join of every token occurrence."""
    from pyspark.sql import Window
    corpus = counts.groupBy("token").agg(F.sum("c").alias("n"))
    g = counts.join(corpus, "token").groupBy(by).agg(
        F.sum("c").cast("bigint").alias("n_tokens"), F.sum(F.col("c") * F.log("n")).alias("_s"))
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))
    return g.select(by, "n_tokens", (F.col("n_tokens") * F.log(total) - F.col("_s")).alias("nll_sum"))
