"""Queries for the end-to-end flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import tokens as T
from skein.plans.derive import INSTRUCTION_SQL, instruction_rows, sources, sql_hash_long
from skein.plans.lifecycle import prepare_instruction, prepare_pretraining
from skein.plans.q_mixing import WEIGHTS, interleave_ctes
from skein.plans.q_tokens import BLOCK, VOCAB
from skein.plans.registry import register

SEED = 42
TAKE = 1000
BATCH = 8
IBLOCK = 256
_NL = "chr(10)"


def pretrain_mix(spark, sf):
    """Four language sources -> fit 512 -> interleave -> shuffle ->
    batches of 8; summarised per source."""
    return _pretrain(spark, sf, None)


def pretrain_take(spark, sf):
    """E1 with its take option: the first 1000 positions."""
    return _pretrain(spark, sf, TAKE)


def _pretrain(spark, sf, take):
    data = sources(spark, sf).select("source", "idx", "text")
    vocab = T.build_vocab(data, "text", VOCAB)
    out = prepare_pretraining(spark, data, WEIGHTS, vocab, BLOCK, take=take, batch=BATCH, seed=SEED)
    return out.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_tok").cast("bigint").alias("n_tokens"),
        F.max("epoch").alias("max_epoch"), F.count_distinct("idx").alias("n_distinct"),
        F.sum(F.size(F.filter("labels", lambda x: x == -100))).cast("bigint").alias("n_masked"),
        F.min("pos").alias("first_pos"), F.max("batch").alias("last_batch"))


def _pretrain_sql(take: int | None) -> str:
    cond = f"WHERE sh.pos < {take}" if take is not None else ""
    return f"""
WITH {interleave_ctes('all_exhausted')},
sh AS (SELECT p.*, row_number() OVER (ORDER BY {sql_hash_long(SEED, "'shuffle'", 'k')}, k) - 1 AS pos FROM p),
tk AS (SELECT doc_id, least(len(regexp_extract_all(text, '{T.WORD_PATTERN}', 0)), {BLOCK}) AS n_tok FROM documents),
t AS (SELECT sh.source, sh.epoch, sh.pos, r.doc_id FROM sh JOIN r ON sh.source = r.source AND sh.row = r.row
      {cond})
SELECT t.source, count(*) AS n_rows, CAST(sum(tk.n_tok) AS BIGINT) AS n_tokens, max(t.epoch) AS max_epoch,
       count(DISTINCT t.doc_id) AS n_distinct, CAST(sum({BLOCK} - tk.n_tok) AS BIGINT) AS n_masked,
       CAST(min(t.pos) AS BIGINT) AS first_pos, CAST(max(t.pos // {BATCH}) AS BIGINT) AS last_batch
FROM t JOIN tk ON tk.doc_id = t.doc_id GROUP BY t.source
"""


register("pretrain_mix", _pretrain_sql(None))(pretrain_mix)
register("pretrain_take", _pretrain_sql(TAKE))(pretrain_take)


def instruction_splits(spark, sf):
    """Instruction rows -> template -> 90/10 split -> vocabulary of the
    text -> fit 256; per split."""
    fitted, _ = prepare_instruction(instruction_rows(spark, sf), vocab_size=VOCAB, block_size=IBLOCK)
    return fitted.groupBy("split").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("n_tok").cast("bigint").alias("n_tokens"),
        F.count_if(F.col("n_raw") > IBLOCK).alias("n_truncated"),
        F.sum(F.size(F.filter("input_ids", lambda x: x == T.UNK_ID))).cast("bigint").alias("n_unk"))


register("instruction_splits", f"""
WITH {INSTRUCTION_SQL},
f AS (SELECT row_key,
             CASE WHEN input IS NOT NULL AND input <> ''
                  THEN '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Input:' || {_NL} || input
                       || {_NL} || {_NL} || '### Response:' || {_NL} || output
                  ELSE '### Instruction:' || {_NL} || instruction || {_NL} || {_NL} || '### Response:' || {_NL} || output
             END AS text,
             row_number() OVER (ORDER BY row_key) - 1 AS pos FROM inst),
c AS (SELECT *, CAST(floor(count(*) OVER () * 0.9) AS BIGINT) AS cut FROM f),
s AS (SELECT row_key, text, CASE WHEN pos < cut THEN 'train' ELSE 'validation' END AS split FROM c),
tk AS (SELECT row_key, split, regexp_extract_all(text, '{T.WORD_PATTERN}', 0) AS toks FROM s),
cnt AS (SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM tk) GROUP BY tok),
vocab AS (SELECT tok AS token FROM cnt ORDER BY n DESC, tok LIMIT {VOCAB}),
e AS (SELECT row_key, unnest(toks) AS tok, generate_subscripts(toks, 1) AS p FROM tk),
unk AS (SELECT e.row_key, count(*) AS n_unk FROM e LEFT JOIN vocab v ON e.tok = v.token
        WHERE e.p <= {IBLOCK} AND v.token IS NULL GROUP BY e.row_key)
SELECT split, count(*) AS n_rows, CAST(sum(least(len(toks), {IBLOCK})) AS BIGINT) AS n_tokens,
       count(*) FILTER (WHERE len(toks) > {IBLOCK}) AS n_truncated, CAST(sum(coalesce(unk.n_unk, 0)) AS BIGINT) AS n_unk
FROM tk LEFT JOIN unk ON tk.row_key = unk.row_key GROUP BY split
""")(instruction_splits)
