"""Queries for limits, slices, splits, quotas and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import sampling as L
from skein.plans.derive import INSTRUCTION_SQL, instruction_rows, sources, sql_hash_long, sql_hash_uniform
from skein.plans.registry import load, register
from skein.sources.mix import build_mix, eval_split, normalise_mix

EVAL_SIZE = 100
SEED = 42


def head_n_q(spark, sf):
    d = load(spark, sf, "documents").select("doc_id", "lang")
    return L.head_n(d, ["doc_id"], 100)


register("head_n", """
SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 100
""")(head_n_q)


def head_n_indexed(spark, sf):
    """L1 for an n too large for top-k: position filter on the bucketed index."""
    d = load(spark, sf, "documents").select("doc_id", "lang")
    return L.head_n(d, ["doc_id"], 600, how="index")


register("head_n_indexed", """
SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 600
""")(head_n_indexed)


def slice_rows_q(spark, sf):
    rows = instruction_rows(spark, sf).select("row_key", "conv_id", "turn")
    return L.slice_rows(rows, ["row_key"], 100, 200)


register("slice_rows", f"""
WITH {INSTRUCTION_SQL},
r AS (SELECT row_key, conv_id, turn, row_number() OVER (ORDER BY row_key) - 1 AS p FROM inst)
SELECT row_key, conv_id, turn FROM r WHERE p >= 100 AND p < 200
""")(slice_rows_q)


def tail_split_q(spark, sf):
    d = load(spark, sf, "documents").select("doc_id")
    return L.tail_split(d, ["doc_id"], 0.9, max_train=None, max_eval=None).select("doc_id", "pos", "split")


register("tail_split", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)
SELECT doc_id, CAST(pos AS BIGINT) AS pos,
       CASE WHEN pos < CAST(floor(n * 0.9) AS BIGINT) THEN 'train' ELSE 'validation' END AS split
FROM r
""")(tail_split_q)


def tail_split_capped(spark, sf):
    """L1 -> L3 -> L1: cap train to 700 rows, split 90/10, cap eval to 50."""
    d = load(spark, sf, "documents").select("doc_id")
    return L.tail_split(d, ["doc_id"], 0.9, max_train=700, max_eval=50).select("doc_id", "pos", "split")


register("tail_split_capped", """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS pos FROM documents),
c AS (SELECT doc_id, pos, CAST(floor(count(*) OVER () * 0.9) AS BIGINT) AS cut FROM r WHERE pos < 700)
SELECT doc_id, CAST(pos AS BIGINT) AS pos, CASE WHEN pos < cut THEN 'train' ELSE 'validation' END AS split
FROM c WHERE pos < cut + 50
""")(tail_split_capped)


def eval_quota_q(spark, sf):
    src = sources(spark, sf).select("source", "idx")
    return L.eval_quota(src, "source", ["idx"], EVAL_SIZE // 4)


register("eval_quota", f"""
WITH r AS (SELECT lang AS source, doc_id AS idx, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
           FROM documents)
SELECT source, idx FROM r WHERE rn <= {EVAL_SIZE // 4}
""")(eval_quota_q)


def eval_sample_q(spark, sf):
    src = sources(spark, sf).select("source", "idx")
    return L.eval_sample(src, "source", ["idx"], EVAL_SIZE // 4, SEED)


register("eval_sample", f"""
WITH r AS (SELECT lang AS source, doc_id AS idx,
                  row_number() OVER (PARTITION BY lang ORDER BY {sql_hash_long(SEED, "'sample'", 'lang', 'doc_id')}, doc_id) AS rn
           FROM documents)
SELECT source, idx FROM r WHERE rn <= {EVAL_SIZE // 4}
""")(eval_sample_q)


# Quotas of the default eval size: 10,000 rows over the sources. The group key
# is NULL for a fifth of the rows, the leading order key for a third of them.
LARGE_Q = 10_000 // 4


def _gappy(spark, sf):
    """orders with NULLs in the group (g) and the leading order key (k)."""
    o = load(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return o.select(F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 3).alias("g"),
                    F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey")).alias("k"),
                    F.col("o_orderkey").alias("id"))


_GAPPY_SQL = """g AS (SELECT CASE WHEN o_custkey % 5 <> 0 THEN o_custkey % 3 END AS g,
       CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey END AS k, o_orderkey AS id FROM orders)"""


def eval_quota_large(spark, sf):
    return L.eval_quota(_gappy(spark, sf), "g", ["k", "id"], LARGE_Q, rank="rank")


register("eval_quota_large", f"""
WITH {_GAPPY_SQL},
r AS (SELECT g, k, id, row_number() OVER (PARTITION BY g ORDER BY k NULLS FIRST, id) AS rank FROM g)
SELECT g, k, id, rank FROM r WHERE rank <= {LARGE_Q}
""")(eval_quota_large)


def eval_sample_large(spark, sf):
    return L.eval_sample(_gappy(spark, sf), "g", ["id"], LARGE_Q, SEED)


register("eval_sample_large", f"""
WITH {_GAPPY_SQL},
r AS (SELECT g, k, id, row_number() OVER (PARTITION BY g
             ORDER BY {sql_hash_long(SEED, "'sample'", 'g', 'id')}, id) AS rank FROM g)
SELECT g, k, id FROM r WHERE rank <= {LARGE_Q}
""")(eval_sample_large)


def subsample_shuffled(spark, sf):
    """L8, reference mode: every row, in the seeded order."""
    src = sources(spark, sf).select("source", "idx")
    return L.subsample(src, 0.3, ["source", "idx"], SEED, mode="reference")


register("subsample_shuffled", f"""
SELECT lang AS source, doc_id AS idx,
       CAST(row_number() OVER (ORDER BY {sql_hash_long(SEED, "'shuffle'", 'lang', 'doc_id')}, lang, doc_id) - 1 AS BIGINT) AS pos
FROM documents
""")(subsample_shuffled)


# A four-source mix over documents.lang: two lazily read sources take their
# first q rows, two batch sources a random q; 'de' declares a validation split.
MIX_SPECS = [
    {"name": "en", "weight": 2.0, "streaming": True},
    {"name": "fr", "weight": 1.0, "streaming": True},
    {"name": "de", "weight": 0.5, "streaming": False, "available_splits": ["train", "validation"]},
    {"name": "es", "weight": 0.5, "streaming": False},
]


def eval_set_q(spark, sf):
    mix = normalise_mix(build_mix(spark, MIX_SPECS)).select("source", "src_pos", "streaming")
    src = sources(spark, sf).select("source", "idx")
    q = EVAL_SIZE // len(MIX_SPECS)
    lazy = L.eval_quota(src.join(F.broadcast(mix.filter("streaming")), "source", "left_semi"),
                        "source", ["idx"], q, rank="qrank")
    eager = L.eval_sample(src.join(F.broadcast(mix.filter(~F.col("streaming"))), "source", "left_semi"),
                          "source", ["idx"], q, SEED, rank="qrank")
    # Within a source the concatenation keeps the quota's own order: first
    # rows by idx for lazily read sources, the sample order for batch ones.
    picked = L.eval_set(lazy.unionByName(eager), mix, ["idx"], EVAL_SIZE, rank="qrank")
    # Every source reads 'validation' when it declares one, else 'train'.
    splits = eval_split(build_mix(spark, MIX_SPECS)).select("source", "eval_split")
    return picked.join(F.broadcast(splits), "source").select("source", "idx", "eval_split")


register("eval_set", f"""
WITH r AS (SELECT lang AS source, doc_id AS idx,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn_first,
                  row_number() OVER (PARTITION BY lang ORDER BY {sql_hash_long(SEED, "'sample'", 'lang', 'doc_id')}, doc_id)
                    AS rn_rand
           FROM documents),
m AS (SELECT * FROM (VALUES ('en', 0, true, 'train'), ('fr', 1, true, 'train'), ('de', 2, false, 'validation'),
                            ('es', 3, false, 'train')) t(source, src_pos, streaming, eval_split)),
q AS (SELECT r.source, r.idx, m.src_pos, m.eval_split,
             CASE WHEN m.streaming THEN rn_first ELSE rn_rand END AS qrank FROM r JOIN m ON r.source = m.source
      WHERE (m.streaming AND rn_first <= {EVAL_SIZE // 4}) OR (NOT m.streaming AND rn_rand <= {EVAL_SIZE // 4}))
SELECT source, idx, eval_split FROM q ORDER BY src_pos, qrank LIMIT {EVAL_SIZE}
""")(eval_set_q)


def subsample_q(spark, sf):
    src = sources(spark, sf).select("source", "idx")
    return L.subsample(src, 0.3, ["source", "idx"], SEED)


register("subsample", f"""
SELECT lang AS source, doc_id AS idx FROM documents WHERE {sql_hash_uniform(SEED, "'subsample'", 'lang', 'doc_id')} < 0.3
""")(subsample_q)


def overlap_report(spark, sf):
    """Eval rows are drawn from 'train' (no validation split declared),
    so they are also trained on; report the overlap and the excluded set."""
    src = sources(spark, sf).select("source", "idx")
    evald = L.eval_quota(src, "source", ["idx"], EVAL_SIZE // 4)
    both = L.overlap(src, evald, ["source", "idx"])
    kept = L.exclude_eval(src, evald, ["source", "idx"])
    n_train = src.groupBy("source").agg(F.count(F.lit(1)).alias("n_train"))
    n_eval = evald.groupBy("source").agg(F.count(F.lit(1)).alias("n_eval"))
    n_both = both.groupBy("source").agg(F.count(F.lit(1)).alias("n_overlap"))
    n_kept = kept.groupBy("source").agg(F.count(F.lit(1)).alias("n_train_excl"))
    return n_train.join(n_eval, "source", "left").join(n_both, "source", "left").join(n_kept, "source", "left") \
        .select("source", "n_train", F.coalesce("n_eval", F.lit(0)).alias("n_eval"),
                F.coalesce("n_overlap", F.lit(0)).alias("n_overlap"),
                F.coalesce("n_train_excl", F.lit(0)).alias("n_train_excl"))


register("overlap_report", f"""
WITH r AS (SELECT lang AS source, doc_id AS idx, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn
           FROM documents)
SELECT source, count(*) AS n_train, count(*) FILTER (WHERE rn <= {EVAL_SIZE // 4}) AS n_eval,
       count(*) FILTER (WHERE rn <= {EVAL_SIZE // 4}) AS n_overlap,
       count(*) FILTER (WHERE rn > {EVAL_SIZE // 4}) AS n_train_excl
FROM r GROUP BY source
""")(overlap_report)


def source_read(spark, sf):
    """S1/S4/S7 + P4: three driver tables read as sources by spec; the text
    column of each is resolved by name; sizes per (source, split)."""
    from skein.operators.formatting import resolve_text
    from skein.sources.readers import read_source
    specs = [{"name": t, "path": f"{sf.rstrip('/')}/{t}.parquet", "format": "parquet", "streaming": False}
             for t in ("documents", "benchmark", "conversations")]
    out = None
    for spec in specs:
        df = resolve_text(read_source(spark, spec)).select("source", "split", "text")
        out = df if out is None else out.unionByName(df)
    return out.groupBy("source", "split").agg(F.count(F.lit(1)).alias("n_rows"),
                                              F.sum(F.length("text")).cast("bigint").alias("n_chars"))


register("source_read", """
SELECT 'documents' AS source, 'train' AS split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents
UNION ALL SELECT 'benchmark', 'train', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark
UNION ALL SELECT 'conversations', 'train', count(*), CAST(sum(length(text)) AS BIGINT) FROM conversations
""")(source_read)
