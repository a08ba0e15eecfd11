"""Queries for the streaming forms (X1-X5) and the Python-worker paths.

Each stream reads a driver table as a file source, runs to completion with
``availableNow`` and writes under the shared checkpoint folder; the query then
reads the sink back. Stream output must equal the batch operator's output, so
the oracles are the batch queries' SQL.
"""

from __future__ import annotations


from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators import infer as U
from skein.operators import tokens as T
from skein.plans import q_halting, q_sampling, q_tokens
from skein.plans.derive import sql_hash_long
from skein.plans.q_format import wrap_prompt_q
from skein.plans.registry import ORACLE, load, register
from skein.streaming import prepare as X
from skein.streaming.halting import stream_halting as _stream_halting
from skein.streaming.quota import stream_quota_state

SEED = 42


def _stream_of(spark, sf, table):
    schema = load(spark, sf, table).schema
    return X.table_stream(spark, f"{sf.rstrip('/')}/{table}.parquet", schema)


def stream_prepare_q(spark, sf):
    """Documents stream -> tokenize -> fit 512 -> mask, per micro-batch;
    the result is summarised like the flagship query (stream = batch)."""
    docs = load(spark, sf, "documents").select("doc_id", "lang", "text")
    vocab_path = X.scratch(spark, "vocab")
    T.build_vocab(docs, "text", q_tokens.VOCAB).write.parquet(vocab_path)
    vocab = spark.read.parquet(vocab_path)

    def prepare(batch):
        return T.tokenize(batch.select("doc_id", "lang", "text"), ["doc_id", "lang"], vocab, "text",
                          q_tokens.BLOCK)

    sink, ckpt = X.scratch(spark, "prepared"), X.scratch(spark, "ckpt")
    X.stream_prepare(_stream_of(spark, sf, "documents"), prepare, sink, ckpt).awaitTermination()
    fitted = X.read_batches(spark, sink)
    B = q_tokens.BLOCK
    return fitted.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tok").cast("bigint").alias("n_tokens"),
        F.sum(F.size(F.filter("attention_mask", lambda m: m == 0))).cast("bigint").alias("n_pad"),
        F.round(F.sum(F.size(F.filter("attention_mask", lambda m: m == 0))) / (F.count(F.lit(1)) * B), 6)
         .alias("pad_frac"),
        F.count_if(F.col("n_raw") > B).alias("n_truncated"),
        F.sum(F.size(F.filter("input_ids", lambda x: x == T.UNK_ID))).cast("bigint").alias("n_unk"),
        F.sum(F.size(F.filter("labels", lambda x: x == -100))).cast("bigint").alias("n_masked"))


register("stream_prepare", ORACLE["corpus_token_stats"])(stream_prepare_q)


def stream_take_q(spark, sf):
    """Take 100 rows of the documents stream."""
    sink, ckpt = X.scratch(spark, "take"), X.scratch(spark, "ckpt")
    X.stream_take(_stream_of(spark, sf, "documents").select("doc_id", "lang"), 100, sink, ckpt).awaitTermination()
    return spark.read.parquet(sink).agg(F.count(F.lit(1)).alias("n_rows"),
                                        F.count_distinct("doc_id").alias("n_distinct"))


register("stream_take", """
SELECT least(count(*), 100) AS n_rows, least(count(DISTINCT doc_id), 100) AS n_distinct FROM documents
""")(stream_take_q)


def stream_shuffle_q(spark, sf):
    """Shuffle buffer of one micro-batch (here the whole file)."""
    sink, ckpt = X.scratch(spark, "shuffle"), X.scratch(spark, "ckpt")
    X.stream_shuffle(_stream_of(spark, sf, "documents").select("doc_id"), ["doc_id"], sink, ckpt,
                     SEED).awaitTermination()
    return X.read_batches(spark, sink).select("doc_id", "pos")


register("stream_shuffle", f"""
SELECT doc_id, CAST(row_number() OVER (ORDER BY {sql_hash_long(SEED, "'shuffle'", 'doc_id')}, doc_id) - 1 AS BIGINT) AS pos
FROM documents
""")(stream_shuffle_q)


def stream_quota_q(spark, sf):
    """First q rows per source from the stream."""
    sink, ckpt = X.scratch(spark, "quota"), X.scratch(spark, "ckpt")
    sdf = _stream_of(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("idx"))
    X.stream_quota(sdf, "source", ["idx"], q_sampling.EVAL_SIZE // 4, sink, ckpt).awaitTermination()
    return X.read_batches(spark, sink).select("source", "idx")


register("stream_quota", ORACLE["eval_quota"])(stream_quota_q)


def stream_quota_state_q(spark, sf):
    """X4 with the quota in the state store: documents in several files, one file a trigger."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    src, sink, ckpt = X.scratch(spark, "quota-in"), X.scratch(spark, "quota-out"), X.scratch(spark, "ckpt")
    docs = load(spark, sf, "documents").select(F.col("lang").alias("source"), F.col("doc_id").alias("idx"))
    for lo, hi in ((None, 0.3), (0.3, 0.6), (0.6, None)):               # files in the order of idx, as they would arrive
        cuts = docs.agg(*[F.percentile_approx("idx", x or 0.0).alias(c) for c, x in (("lo", lo), ("hi", hi))]).first()
        part = docs.filter((F.lit(True) if lo is None else F.col("idx") > cuts["lo"])
                           & (F.lit(True) if hi is None else F.col("idx") <= cuts["hi"]))
        part.coalesce(1).write.mode("append").parquet(src)
    sdf = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(src)
    out = stream_quota_state(sdf, "source", ["idx"], q_sampling.EVAL_SIZE // 4)
    try:
        out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt) \
           .trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.schema(docs.schema).parquet(sink).select("source", "idx")


register("stream_quota_state", ORACLE["eval_quota"])(stream_quota_state_q)


def stream_halting_q(spark, sf):
    """The halting rule as per-sequence streaming state."""
    ev = _stream_of(spark, sf, "events")
    steps = ev.select(
        F.col("user_id").alias("seq_id"),
        F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ts_us"),
        "event_id", F.round(F.col("value") / 10.0 - 1.0, 4).alias("q_halt"),
        F.round((F.col("event_id") % 7) / 3.0 - 1.0, 4).alias("q_continue"))
    sink, ckpt = X.scratch(spark, "halting"), X.scratch(spark, "ckpt")
    out = _stream_halting(steps, q_halting.MAXS, True)
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt) \
       .trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(sink).select("seq_id", "event_id", "rank", "step", "halted")


register("stream_halting", ORACLE["halt_steps_train"])(stream_halting_q)


def stream_halting_state_q(spark, sf):
    """X5 with the counters in the state store: the events arrive in three parts by time, the stream starts anew for each."""
    from skein.plans.derive import steplog
    from skein.streaming.halting_state import stream_halting_state
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    steps = steplog(spark, sf).select("seq_id", F.col("ts_us").cast("long"), "event_id", F.col("q_halt").cast("double"),
                                      F.col("q_continue").cast("double"))
    src, sink, ckpt = X.scratch(spark, "steps-in"), X.scratch(spark, "steps-out"), X.scratch(spark, "ckpt")
    cuts = steps.agg(F.percentile_approx("ts_us", [1 / 3, 2 / 3])).first()[0] or [0, 0]
    part = F.when(F.col("ts_us") <= cuts[0], 0).when(F.col("ts_us") <= cuts[1], 1).otherwise(2)
    try:
        for third in range(3):
            steps.filter(part == third).write.mode("append").parquet(src)
            out = stream_halting_state(X.file_stream(spark, src, steps.schema), q_halting.MAXS, True)
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt) \
               .trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
    return spark.read.parquet(sink).select("seq_id", "event_id", "rank", "step", "halted")


register("stream_halting_state", ORACLE["halt_steps_train"])(stream_halting_state_q)


def batch_infer_q(spark, sf):
    """U4: a user model over the wrapped prompt table (built once per worker)."""
    prompts = wrap_prompt_q(spark, sf)
    return U.batch_infer(prompts, U.tail_echo_factory(16), "wrapped", ["kind", "id"])


register("batch_infer", f"""
WITH w AS ({ORACLE['wrap_prompt']})
SELECT kind, id, right(wrapped, 16) || '|' || CAST(length(wrapped) AS VARCHAR) AS completion FROM w
""")(batch_infer_q)


def batch_score(spark, sf):
    """U4: every document's cost under a character model learnt from all of them (thousandths of a nat)."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    scored = U.batch_infer(docs, U.bigram_scorer_factory(U.bigram_costs(docs)), "text", ["doc_id"], "cost")
    return scored.select("doc_id", F.col("cost").cast("long").alias("cost_milli"))


register("batch_score", """
WITH d AS (SELECT doc_id, regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                                   'abcdefghijklmnopqrstuvwxyz'), '[^a-z]', ' ', 'g') AS t FROM documents),
p AS (SELECT doc_id, substr(t, i, 2) AS p, count(*) AS n
      FROM (SELECT doc_id, t, unnest(range(1, length(t))) AS i FROM d) GROUP BY ALL),
c AS (SELECT p, sum(n) AS n FROM p GROUP BY p),
f AS (SELECT p[1] AS a, sum(n) AS n FROM c GROUP BY p[1]),
w AS (SELECT c.p, CAST(round(1000 * ln((f.n + 27) / (c.n + 1))) AS BIGINT) AS cost FROM c JOIN f ON f.a = c.p[1])
SELECT d.doc_id, CAST(coalesce(sum(p.n * w.cost), 0) AS BIGINT) AS cost_milli
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN w USING (p) GROUP BY d.doc_id
""")(batch_score)


def tokenize_public(spark, sf):
    """A public byte-level BPE tokenizer over whole texts; its ids give back every text."""
    import public_tokenizers
    encoder, decoder = U.rank_tokenizer_factory(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    docs = load(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    back = U.decode_with(U.tokenize_with(docs, encoder, "text"), decoder, "ids")
    return back.select("doc_id", F.octet_length("decoded").cast("long").alias("n_bytes"),
                       (F.col("decoded") == F.col("text")).alias("exact"),
                       ((F.size("ids") > 0) == (F.col("text") != "")).alias("has_ids"))


register("tokenize_public", """
SELECT doc_id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes, true AS exact, true AS has_ids FROM documents
""")(tokenize_public)


def tokenize_udf(spark, sf):
    """A user tokenizer in a pandas UDF, then fit/mask like the native path."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    ids = U.tokenize_with(docs, U.byte_tokenizer_factory(T.BYTE_OFFSET), "text").select("doc_id", "ids")
    out = T.fit(ids.withColumn("n_raw", F.size("ids")), "ids", q_tokens.BLOCK).drop("ids")
    return out.select("doc_id", F.col("n_raw").cast("bigint").alias("n_bytes"), "n_tok",
                      F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                      F.md5(F.array_join("labels", ",")).alias("labels_md5"))


register("tokenize_udf", ORACLE["tokenize_bytes"])(tokenize_udf)


def stream_vocab_q(spark, sf):
    """The vocabulary after the last of three triggers: active tokens, counts; ids are unique and gapless."""
    from skein.streaming import vocabulary as V
    docs = load(spark, sf, "documents").select("doc_id", "text")
    src, path, ckpt = X.scratch(spark, "vocab-in"), X.scratch(spark, "vocab-state"), X.scratch(spark, "ckpt")
    for third in range(3):                                 # each row in one of three writes
        docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(3)) == third).write.mode("append").parquet(src)
    files = -(-len(spark.read.parquet(src).inputFiles()) // 3)
    V.stream_vocab(X.file_stream(spark, src, docs.schema, max_files_per_trigger=files), path, ckpt,
                   size=q_tokens.VOCAB).awaitTermination()
    vocab = V.latest_vocab(spark, path)
    ids = vocab.agg(F.count_distinct("id").alias("k"), F.max("id").alias("top"), F.count(F.lit(1)).alias("n")).first()
    gapless = ids["k"] == ids["n"] and (ids["top"] or T.FIRST_WORD_ID - 1) == ids["n"] + T.FIRST_WORD_ID - 1
    return vocab.filter("active").select("token", "n", F.lit(gapless).alias("ids_gapless"))


register("stream_vocab", f"""
SELECT token, n, true AS ids_gapless FROM ({ORACLE['build_vocab']})
""")(stream_vocab_q)


def shards_roundtrip(spark, sf):
    """The interleaved plan written as 8 range shards of k, read back."""
    from skein.operators import mixing as M
    from skein.plans.q_mixing import WEIGHTS
    from skein.plans.derive import sources
    from skein.sources.sinks import write_shards
    data = sources(spark, sf).select("source", "idx", "doc_id")
    plan = M.interleave(spark, data, WEIGHTS, ["idx"], SEED, "all_exhausted").select("k", "source", "epoch", "doc_id")
    path = X.scratch(spark, "shards")
    write_shards(plan, path, 8, "k")
    return spark.read.parquet(path)


register("shards_roundtrip", ORACLE["interleave_exhausted"])(shards_roundtrip)


def _plan_shards(spark, sf):
    from skein.operators import mixing as M
    from skein.plans.q_mixing import WEIGHTS
    from skein.plans.derive import sources
    from skein.sources.shards import write_shard_set
    data = sources(spark, sf).select("source", "idx", "doc_id")
    plan = M.interleave(spark, data, WEIGHTS, ["idx"], SEED, "all_exhausted").select("k", "source", "epoch", "doc_id")
    path = X.scratch(spark, "shard-set")
    return path, write_shard_set(plan, path, 1, 8, "k")


def shards_resume(spark, sf):
    """The interleaved plan as a shard set, read from two thirds of its rows on."""
    from skein.sources.shards import read_shard_set
    path, m = _plan_shards(spark, sf)
    n = m.agg(F.sum("n_rows")).first()[0] or 0
    return read_shard_set(spark, path, start=2 * n // 3)


register("shards_resume", f"""
WITH p AS ({ORACLE['interleave_exhausted']})
SELECT * FROM p WHERE k >= (SELECT 2 * count(*) // 3 FROM p)
""")(shards_resume)


def shards_manifest(spark, sf):
    """What the manifest says of the set (rows, range, order of the shards) and how many shards differ from it."""
    from skein.sources.shards import damaged_shards
    path, m = _plan_shards(spark, sf)
    bad = damaged_shards(spark, path).select("file", F.lit(True).alias("bad"))
    before = F.max("last").over(Window.orderBy("first", "file").rowsBetween(Window.unboundedPreceding, -1))   # one row a shard
    return m.withColumn("before", before).join(bad, "file", "left").agg(
        F.sum("n_rows").alias("n_rows"), F.min("first").alias("first_k"), F.max("last").alias("last_k"),
        F.count("bad").alias("n_damaged"), F.count_if(F.col("before") >= F.col("first")).alias("n_overlaps"))


register("shards_manifest", f"""
WITH p AS ({ORACLE['interleave_exhausted']})
SELECT count(*) AS n_rows, min(k) AS first_k, max(k) AS last_k, CAST(0 AS BIGINT) AS n_damaged, CAST(0 AS BIGINT) AS n_overlaps FROM p
""")(shards_manifest)


def stream_bytes(spark, sf):
    """X1 direct form: the byte tokenizer has no aggregation, so the stream
    is a plain projection written in append mode (exactly-once file sink)."""
    sdf = _stream_of(spark, sf, "documents").select("doc_id", "text")
    out = T.tokenize_bytes(sdf, ["doc_id"], "text", q_tokens.BLOCK)
    sink, ckpt = X.scratch(spark, "bytes"), X.scratch(spark, "ckpt")
    out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt) \
       .trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(sink)
    return back.select("doc_id", F.col("n_raw").cast("bigint").alias("n_bytes"), "n_tok",
                       F.md5(F.array_join("input_ids", ",")).alias("ids_md5"),
                       F.md5(F.array_join("labels", ",")).alias("labels_md5"))


register("stream_bytes", ORACLE["tokenize_bytes"])(stream_bytes)
