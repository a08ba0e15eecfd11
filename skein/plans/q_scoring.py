"""Queries for scoring, losses and corpus metrics."""

from __future__ import annotations


from pyspark.sql import functions as F

from skein.operators import halting as W
from skein.operators import sampling as L
from skein.operators import scoring as A
from skein.operators import sharded as S
from skein.operators import sketches as K
from skein.operators import tokens as T
from skein.plans.derive import PRED_SQL, RUN_METRICS_SQL, pred_rows, run_metrics, sources, steplog
from skein.plans.q_halting import MAXS, ORDER, halting_sql
from skein.plans.q_mixing import _weights_sql
from skein.plans.q_tokens import BLOCK, VOCAB, _vocab_sql
from skein.plans.registry import load, register
from skein.session import stored

_SOFTMAX_NLL = "(m + ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) - logits[label + 1])"
_STABLE_S = "list_transform(logits, lambda x: CASE WHEN x < 0 THEN 1.0 / (1.0 - x + 1e-30) ELSE x + 1.0 END)"
_STABLE_NLL = f"(-ln({_STABLE_S}[label + 1] / list_sum({_STABLE_S})))"


def _tok_sql(nll: str) -> str:
    return f"""{PRED_SQL},
pm AS (SELECT *, list_max(logits) AS m FROM pred),
t AS (SELECT seq_id, label, label <> -100 AS valid,
             label <> -100 AND list_position(logits, m) - 1 = label AS correct,
             CASE WHEN label <> -100 THEN {nll} ELSE 0.0 END AS nll FROM pm),
s AS (SELECT seq_id, count(*) FILTER (WHERE valid) AS n_valid, count(*) FILTER (WHERE correct) AS n_correct,
             sum(nll) AS nll_sum FROM t GROUP BY seq_id)"""


def _seq_cols(seq):
    return seq.select("seq_id", "n_valid", "n_correct", "exact",
                      F.round("seq_loss", 6).alias("seq_loss"), F.round("seq_accuracy", 6).alias("seq_accuracy"))


_SEQ_SELECT = """
SELECT seq_id, n_valid, n_correct, n_correct = n_valid AS exact,
       round(nll_sum / greatest(n_valid, 1), 6) AS seq_loss, round(n_correct / greatest(n_valid, 1), 6) AS seq_accuracy
FROM s"""


def score_softmax(spark, sf):
    return _seq_cols(A.score_sequences(A.score_tokens(pred_rows(spark, sf), "softmax")))


register("score_softmax", f"WITH {_tok_sql(_SOFTMAX_NLL)} {_SEQ_SELECT}")(score_softmax)


def score_stablemax(spark, sf):
    return _seq_cols(A.score_sequences(A.score_tokens(pred_rows(spark, sf), "stablemax")))


register("score_stablemax", f"WITH {_tok_sql(_STABLE_NLL)} {_SEQ_SELECT}")(score_stablemax)


# The same losses from logits that are cut into vocabulary shards.
SHARD = 24


def score_softmax_sharded(spark, sf):
    shards = S.shard_logits(pred_rows(spark, sf), SHARD)
    return _seq_cols(A.score_sequences(S.score_shards(shards, ["seq_id", "pos"], SHARD, "softmax")))


def score_stablemax_sharded(spark, sf):
    shards = S.shard_logits(pred_rows(spark, sf), SHARD)
    return _seq_cols(A.score_sequences(S.score_shards(shards, ["seq_id", "pos"], SHARD, "stablemax")))


register("score_softmax_sharded", f"WITH {_tok_sql(_SOFTMAX_NLL)} {_SEQ_SELECT}")(score_softmax_sharded)
register("score_stablemax_sharded", f"WITH {_tok_sql(_STABLE_NLL)} {_SEQ_SELECT}")(score_stablemax_sharded)


def _rollup(spark, sf):
    seq = A.score_sequences(A.score_tokens(pred_rows(spark, sf), "softmax"))
    state = W.halt_state(W.halt_targets(W.halt_steps(steplog(spark, sf), ORDER, MAXS, True), MAXS))
    j = seq.join(state, "seq_id", "left").select(
        "seq_id", "n_valid", "n_correct", "exact", "nll_sum", "seq_loss", "seq_accuracy",
        F.coalesce("halted", F.lit(False)).alias("halted"), F.coalesce("steps", F.lit(0)).alias("steps"),
        F.coalesce("q_halt", F.lit(0.0)).alias("q_halt"), F.coalesce("q_continue", F.lit(0.0)).alias("q_continue"),
        "target_q_continue")
    return A.rollup_scores(j)


_ROLLUP_SQL = f"""
WITH {_tok_sql(_SOFTMAX_NLL)}, {halting_sql(True).replace(PRED_SQL, '')},
q AS (SELECT s.seq_id, s.n_valid, s.n_correct, s.nll_sum, s.n_correct = s.n_valid AS exact,
             s.nll_sum / greatest(s.n_valid, 1) AS seq_loss, s.n_correct / greatest(s.n_valid, 1) AS seq_accuracy,
             coalesce(hs.halted, false) AS halted, coalesce(hs.steps, 0) AS steps,
             coalesce(hs.q_halt, 0.0) AS q_halt, coalesce(hs.q_continue, 0.0) AS q_continue, hs.target_q_continue
      FROM s LEFT JOIN hs ON s.seq_id = hs.seq_id),
b AS (SELECT *, halted AND n_valid > 0 AS vm,
             greatest(q_halt, 0.0) - q_halt * CAST(exact AS DOUBLE) + ln(1 + exp(-abs(q_halt))) AS hl,
             CASE WHEN target_q_continue IS NOT NULL THEN
               greatest(q_continue, 0.0) - q_continue * target_q_continue + ln(1 + exp(-abs(q_continue))) END AS cl
      FROM q),
g AS (SELECT count(*) FILTER (WHERE vm) AS count,
             sum(CASE WHEN vm THEN seq_accuracy ELSE 0.0 END) AS accuracy,
             count(*) FILTER (WHERE vm AND exact) AS exact_accuracy,
             count(*) FILTER (WHERE vm AND ((q_halt >= 0) = exact)) AS q_halt_accuracy,
             CAST(sum(CASE WHEN vm THEN steps ELSE 0 END) AS BIGINT) AS steps,
             sum(seq_loss) AS lm_loss, sum(nll_sum) / greatest(sum(n_valid), 1) AS lm_loss_micro,
             sum(n_correct) / greatest(sum(n_valid), 1) AS token_accuracy,
             sum(hl) AS q_halt_loss, coalesce(sum(cl), 0.0) AS q_continue_loss FROM b)"""


def seq_accuracy_rollup(spark, sf):
    r = _rollup(spark, sf)
    return r.select("count", F.round("accuracy", 6).alias("accuracy"), "exact_accuracy", "q_halt_accuracy", "steps",
                    F.round("accuracy_mean", 6).alias("accuracy_mean"),
                    F.round("token_accuracy", 6).alias("token_accuracy"),
                    F.round("exact_accuracy_mean", 6).alias("exact_accuracy_mean"))


register("seq_accuracy_rollup", _ROLLUP_SQL + """
SELECT count, round(accuracy, 6) AS accuracy, exact_accuracy, q_halt_accuracy, steps,
       round(accuracy / greatest(count, 1), 6) AS accuracy_mean, round(token_accuracy, 6) AS token_accuracy,
       round(exact_accuracy / greatest(count, 1), 6) AS exact_accuracy_mean FROM g
""")(seq_accuracy_rollup)


def halt_losses(spark, sf):
    r = _rollup(spark, sf)
    return r.select(*[F.round(c, 6).alias(c) for c in
                      ("lm_loss", "lm_loss_micro", "q_halt_loss", "q_continue_loss", "total_loss")])


register("halt_losses", _ROLLUP_SQL + """
SELECT round(lm_loss, 6) AS lm_loss, round(lm_loss_micro, 6) AS lm_loss_micro, round(q_halt_loss, 6) AS q_halt_loss,
       round(q_continue_loss, 6) AS q_continue_loss,
       round(lm_loss + 0.5 * (q_halt_loss + q_continue_loss), 6) AS total_loss FROM g
""")(halt_losses)


def perplexity_by_label(spark, sf):
    """A12 on micro loss per target class."""
    t = A.valid_tokens(A.score_tokens(pred_rows(spark, sf), "softmax"))
    g = t.groupBy("label").agg(F.count(F.lit(1)).alias("n_tokens"), F.avg("nll").alias("loss"))
    return g.select("label", "n_tokens", F.round("loss", 6).alias("loss"),
                    F.round(A.perplexity(F.col("loss")), 6).alias("perplexity"))


register("perplexity_by_label", f"""
WITH {_tok_sql(_SOFTMAX_NLL)}
SELECT label, count(*) AS n_tokens, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 6) AS perplexity
FROM t WHERE valid GROUP BY label
""")(perplexity_by_label)


def improvement_q(spark, sf):
    m = run_metrics(spark, sf)             # and the same runs with losses whose perplexity overflows
    high = m.withColumn("run_id", F.concat(F.lit("high-"), "run_id")).withColumn("value", F.col("value") + 1000)
    r = A.improvement(m.unionByName(high))
    return r.select("run_id", "n_evals", *[F.round(c, 6).alias(c) for c in
                    ("loss_first", "loss_last", "loss_improvement", "ppl_first", "ppl_last", "ppl_improvement")])


register("improvement", f"""
WITH {RUN_METRICS_SQL},
m AS (SELECT run_id, step, value FROM run_metrics UNION ALL SELECT 'high-' || run_id, step, value + 1000 FROM run_metrics),
g AS (SELECT run_id, count(*) AS n_evals, arg_min(value, step) AS a, arg_max(value, step) AS b
      FROM m GROUP BY run_id)
SELECT run_id, n_evals, round(a, 6) AS loss_first, round(b, 6) AS loss_last, round((a - b) / a, 6) AS loss_improvement,
       round(exp(a), 6) AS ppl_first, round(exp(b), 6) AS ppl_last, round(1.0 - exp(b - a), 6) AS ppl_improvement
FROM g
""")(improvement_q)


def split_sizes_q(spark, sf):
    d = load(spark, sf, "documents").select("doc_id")
    return A.split_sizes(L.tail_split(d, ["doc_id"], 0.9))


register("split_sizes", """
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT CASE WHEN pos < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'validation' END AS split,
       count(*) AS n_rows FROM r GROUP BY 1
""")(split_sizes_q)


def bits_per_byte_q(spark, sf):
    """A14 under a unigram model of the whole corpus: token nll = -ln(n_t / N).

    Tokens are counted per (lang, token) first, so the join with the corpus
    counts sees distinct pairs, not every occurrence of a hot token."""
    docs = load(spark, sf, "documents").select("lang", "text")
    nll = A.unigram_nll(T.token_counts(docs, ["lang"]), "lang")
    return A.bits_per_byte(nll, docs, "lang").select("lang", "n_tokens", "n_bytes",
                                                     F.round("bits_per_byte", 6).alias("bits_per_byte"))


register("bits_per_byte", f"""
WITH e AS (SELECT lang, unnest(regexp_extract_all(text, '{T.WORD_PATTERN}', 0)) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM e GROUP BY token),
tot AS (SELECT sum(n) AS total FROM c),
x AS (SELECT e.lang, -ln(c.n / tot.total) AS nll FROM e JOIN c ON e.token = c.token, tot),
s AS (SELECT lang, sum(nll) AS nll_sum, count(*) AS n_tokens FROM x GROUP BY lang),
b AS (SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY lang)
SELECT s.lang, s.n_tokens, b.n_bytes, round(s.nll_sum / ln(2) / b.n_bytes, 6) AS bits_per_byte
FROM s JOIN b ON s.lang = b.lang
""")(bits_per_byte_q)


def distinct_ids_q(spark, sf):
    """A16 per language, from distinct (lang, token) pairs."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "text")
    vocab = T.build_vocab(docs, "text", VOCAB)
    pairs = T.token_counts(docs, ["lang"]).join(vocab.select("token", "id"), "token", "left") \
        .withColumn("id", F.coalesce("id", F.lit(T.UNK_ID)))
    return A.distinct_ids(pairs, "id", "lang")


register("distinct_ids", f"""
WITH {_vocab_sql()},
e AS (SELECT lang, unnest(toks) AS tok FROM tk)
SELECT e.lang, count(DISTINCT coalesce(v.id, 1)) AS n_distinct FROM e LEFT JOIN vocab v ON e.tok = v.token
GROUP BY e.lang
""")(distinct_ids_q)


def mix_report(spark, sf):
    """Per source rows, tokens, token share vs target weight, unknown and
    padding fractions at the block size. Counts come from per-row token
    counts and pre-aggregated (source, token) pairs; no id arrays are built."""
    from skein.plans.q_sampling import MIX_SPECS
    from skein.sources.mix import build_mix, normalise_mix
    src = sources(spark, sf).select("source", "idx", "text")
    vocab = T.build_vocab(src, "text", VOCAB)
    unk = T.unk_counts(T.token_counts(src, ["source"]), ["source"], vocab).select("source", "n_unk")
    rows = src.select("source", F.size(T.split_tokens("text")).alias("n_tok"))
    per = rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_tok").cast("bigint").alias("n_tokens"),
        F.sum(F.greatest(F.lit(0), F.lit(BLOCK) - F.col("n_tok"))).cast("bigint").alias("n_pad"))
    per = per.join(unk, "source")
    mix = normalise_mix(build_mix(spark, MIX_SPECS)).select("source", "weight_norm")
    return A.mix_report(per, mix, BLOCK, PARAMETERS)


PARAMETERS = 27_000_000


register("mix_report", f"""
WITH {_vocab_sql()},
e AS (SELECT tk.lang, u.tok FROM tk, unnest(tk.toks) AS u(tok)),
unk AS (SELECT e.lang, count(*) FILTER (WHERE v.token IS NULL) AS n_unk FROM e LEFT JOIN vocab v ON e.tok = v.token
        GROUP BY e.lang),
per AS (SELECT lang AS source, count(*) AS n_rows, CAST(sum(len(toks)) AS BIGINT) AS n_tokens,
               CAST(sum(greatest(0, {BLOCK} - len(toks))) AS BIGINT) AS n_pad FROM tk GROUP BY lang),
tot AS (SELECT sum(n_tokens) AS t FROM per)
SELECT per.source, per.n_rows, per.n_tokens, round(per.n_tokens / tot.t, 6) AS token_share,
       round(CAST(m.weight_norm AS DOUBLE), 6) AS weight_norm,
       round(per.n_tokens / tot.t / CAST(m.weight_norm AS DOUBLE), 6) AS share_over_weight,
       round(unk.n_unk / per.n_tokens, 6) AS unk_frac, round(per.n_pad / (per.n_rows * {BLOCK}), 6) AS pad_frac,
       round(CAST({20 * PARAMETERS} AS DOUBLE) * CAST(m.weight_norm AS DOUBLE), 3) AS budget_tokens,
       round(CAST({20 * PARAMETERS} AS DOUBLE) * CAST(m.weight_norm AS DOUBLE) / per.n_tokens, 6) AS budget_epochs
FROM per JOIN unk ON per.source = unk.lang JOIN {_weights_sql()} ON per.source = m.source, tot
""")(mix_report)


def perplexity_by_source(spark, sf):
    """A12 per source: exp(mean token nll) under the corpus unigram model."""
    src = sources(spark, sf).select("source", "text")
    nll = A.unigram_nll(T.token_counts(src, ["source"]), "source")
    return nll.select("source", "n_tokens", F.round(F.col("nll_sum") / F.col("n_tokens"), 6).alias("loss"),
                      F.round(A.perplexity(F.col("nll_sum") / F.col("n_tokens")), 6).alias("perplexity"))


register("perplexity_by_source", f"""
WITH e AS (SELECT lang, unnest(regexp_extract_all(text, '{T.WORD_PATTERN}', 0)) AS token FROM documents),
c AS (SELECT token, count(*) AS n FROM e GROUP BY token),
tot AS (SELECT sum(n) AS total FROM c),
x AS (SELECT e.lang, -ln(c.n / tot.total) AS nll FROM e JOIN c ON e.token = c.token, tot)
SELECT lang AS source, count(*) AS n_tokens, round(avg(nll), 6) AS loss, round(exp(avg(nll)), 6) AS perplexity
FROM x GROUP BY lang
""")(perplexity_by_source)


# ---------------------------------------------------------------------------
# A16/L9 from mergeable sketches, next to the exact counts and within the stated bound of them.

def _word_rows(spark, sf):
    docs = load(spark, sf, "documents").select("lang", "source", "doc_id", "text")
    return docs.select("lang", "source", (F.col("doc_id") % 10 == 0).alias("is_eval"), F.explode(T.split_tokens("text")).alias("word"))


def sketch_distinct(spark, sf):
    """Distinct words of each language from stored sketches of its sources, with the exact number."""
    words = _word_rows(spark, sf)
    parts = stored(K.sketch_table(words, ["lang", "source"], "word"), "sketches")
    got = K.estimates(K.merge_sketches(parts, ["lang"]))
    exact = T.token_counts(load(spark, sf, "documents").select("lang", "text"), ["lang"]) \
        .groupBy("lang").agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("c").cast("bigint").alias("n_words"))
    return got.join(exact, "lang").select("lang", "n_words", "n_distinct", (F.col("n_rows") == F.col("n_words")).alias("all_rows"),
                                          (F.abs(F.col("estimate") - F.col("n_distinct")) <= F.col("margin")).alias("within"))


register("sketch_distinct", f"""
WITH e AS (SELECT lang, unnest(regexp_extract_all(text, '{T.WORD_PATTERN}', 0)) AS word FROM documents)
SELECT lang, count(*) AS n_words, count(DISTINCT word) AS n_distinct, true AS all_rows, true AS within FROM e GROUP BY lang
""")(sketch_distinct)


def sketch_overlap(spark, sf):
    """Words that the training and the eval part of a language share, from sketches of both, with the exact number."""
    words = _word_rows(spark, sf)
    parts = stored(K.sketch_table(words, ["lang", "is_eval"], "word"), "sketches")
    got = K.overlaps(parts.filter("not is_eval"), parts.filter("is_eval"), ["lang"])
    exact = words.groupBy("lang", "word").agg(F.min("is_eval").alias("a"), F.max("is_eval").alias("b")).filter("not a and b") \
        .groupBy("lang").agg(F.count(F.lit(1)).alias("n_both"))
    return got.join(exact, "lang").select("lang", "n_both", (F.abs(F.col("estimate") - F.col("n_both")) <= F.col("margin")).alias("within"))


register("sketch_overlap", f"""
WITH e AS (SELECT DISTINCT lang, doc_id % 10 = 0 AS is_eval, unnest(regexp_extract_all(text, '{T.WORD_PATTERN}', 0)) AS word FROM documents),
b AS (SELECT lang, word FROM e GROUP BY lang, word HAVING count(*) = 2)
SELECT lang, count(*) AS n_both, true AS within FROM b GROUP BY lang
""")(sketch_overlap)
