"""Queries for tokenization, vocabulary, fit, masks and decode."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.arrays import mask_pad
from skein.operators import tokens as T
from skein.plans.registry import load, register
from skein.session import stored

VOCAB = 4096
BLOCK = 512


def _vocab_sql(pattern: str = T.WORD_PATTERN, size: int = VOCAB, src: str = "documents") -> str:
    return f"""
    tk AS (SELECT doc_id, lang, text, regexp_extract_all(text, '{pattern}', 0) AS toks FROM {src}),
    cnt AS (SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM tk) GROUP BY tok),
    vocab AS (SELECT tok AS token, CAST(row_number() OVER (ORDER BY n DESC, tok) + 1 AS INTEGER) AS id, n
              FROM (SELECT tok, n FROM cnt ORDER BY n DESC, tok LIMIT {size}))"""


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang", "text")


# ---------------------------------------------------------------------------
# Flagship: documents -> regex tokens -> vocab ids -> fit 512 -> label mask ->
# per-language rows, tokens, padding, truncation, unknowns, masked labels.

def corpus_token_stats(spark, sf):
    docs = _docs(spark, sf)
    vocab = T.build_vocab(docs, "text", VOCAB)
    fitted = T.tokenize(docs, ["doc_id", "lang"], vocab, "text", BLOCK)
    return fitted.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("n_tok").cast("bigint").alias("n_tokens"),
        F.sum(F.size(F.filter("attention_mask", lambda m: m == 0))).cast("bigint").alias("n_pad"),
        F.round(F.sum(F.size(F.filter("attention_mask", lambda m: m == 0))) / (F.count(F.lit(1)) * BLOCK), 6)
         .alias("pad_frac"),
        F.count_if(F.col("n_raw") > BLOCK).alias("n_truncated"),
        F.sum(F.size(F.filter("input_ids", lambda x: x == T.UNK_ID))).cast("bigint").alias("n_unk"),
        F.sum(F.size(F.filter("labels", lambda x: x == -100))).cast("bigint").alias("n_masked"),
    )


register("corpus_token_stats", f"""
WITH {_vocab_sql()},
e AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM tk),
unk AS (SELECT e.doc_id, count(*) AS n_unk FROM e LEFT JOIN vocab v ON e.tok = v.token
        WHERE e.pos <= {BLOCK} AND v.token IS NULL GROUP BY e.doc_id),
d AS (SELECT tk.doc_id, tk.lang, len(toks) AS n_raw, least(len(toks), {BLOCK}) AS n_tok,
             coalesce(unk.n_unk, 0) AS n_unk FROM tk LEFT JOIN unk ON tk.doc_id = unk.doc_id)
SELECT lang, count(*) AS n_docs, CAST(sum(n_tok) AS BIGINT) AS n_tokens,
       CAST(sum({BLOCK} - n_tok) AS BIGINT) AS n_pad,
       round(sum({BLOCK} - n_tok) / (count(*) * {BLOCK}), 6) AS pad_frac,
       CAST(count(*) FILTER (WHERE n_raw > {BLOCK}) AS BIGINT) AS n_truncated,
       CAST(sum(n_unk) AS BIGINT) AS n_unk,
       CAST(sum({BLOCK} - n_tok) AS BIGINT) AS n_masked
FROM d GROUP BY lang
""")(corpus_token_stats)


# ---------------------------------------------------------------------------
# Vocabulary from the corpus.

def build_vocab_q(spark, sf):
    return T.build_vocab(_docs(spark, sf), "text", VOCAB)


register("build_vocab", f"""
WITH {_vocab_sql()}
SELECT token, id, CAST(n AS BIGINT) AS n FROM vocab
""")(build_vocab_q)


# ---------------------------------------------------------------------------
# T1 + P8 + T4 + B1 per row; arrays compared through digests.

def _digest(c):
    return F.md5(F.array_join(c, ","))


def tokenize_regex_fit(spark, sf):
    docs = _docs(spark, sf)
    vocab = T.build_vocab(docs, "text", VOCAB)
    fitted = T.tokenize(docs, ["doc_id"], vocab, "text", BLOCK)
    return fitted.select(
        "doc_id", "n_tok",
        F.slice("input_ids", 1, 8).cast("array<string>").alias("_h"),
        _digest("input_ids").alias("ids_md5"),
        _digest("attention_mask").alias("mask_md5"),
        _digest("labels").alias("labels_md5"),
    ).withColumn("head", F.array_join("_h", " ")).drop("_h")


_FIT_SQL = f"""
WITH {_vocab_sql()},
e AS (SELECT doc_id, unnest(toks[1:{BLOCK}]) AS tok, generate_subscripts(toks[1:{BLOCK}], 1) AS pos FROM tk),
ids AS (SELECT e.doc_id, list(coalesce(v.id, 1) ORDER BY e.pos) AS ids
        FROM e LEFT JOIN vocab v ON e.tok = v.token GROUP BY e.doc_id),
f AS (SELECT tk.doc_id, coalesce(ids.ids, []::INTEGER[]) AS ids FROM tk LEFT JOIN ids ON tk.doc_id = ids.doc_id),
g AS (SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tok,
             list_concat(ids, list_transform(range({BLOCK} - len(ids)), lambda x: 0)) AS input_ids FROM f)
SELECT doc_id, n_tok,
       md5(array_to_string(input_ids, ',')) AS ids_md5,
       md5(array_to_string(list_concat(list_transform(range(n_tok), lambda x: 1),
                                       list_transform(range({BLOCK} - n_tok), lambda x: 0)), ',')) AS mask_md5,
       md5(array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ','))
         AS labels_md5,
       array_to_string(input_ids[1:8], ' ') AS head
FROM g
"""
register("tokenize_regex_fit", _FIT_SQL)(tokenize_regex_fit)


# ---------------------------------------------------------------------------
# Byte tokenizer with fit; decode round trip (T3 o T1 = identity for bytes).

def tokenize_bytes_q(spark, sf):
    docs = _docs(spark, sf)
    out = T.tokenize_bytes(docs, ["doc_id"], "text", BLOCK)
    return out.select("doc_id", F.col("n_raw").cast("bigint").alias("n_bytes"), "n_tok",
                      _digest("input_ids").alias("ids_md5"), _digest("labels").alias("labels_md5"))


register("tokenize_bytes", f"""
WITH b AS (SELECT doc_id, list_transform(regexp_extract_all(hex(text), '..', 0),
                                          lambda h: CAST(('0x' || h) AS INTEGER) + 2) AS ids FROM documents),
f AS (SELECT doc_id, len(ids) AS n_bytes, ids[1:{BLOCK}] AS t FROM b),
g AS (SELECT doc_id, n_bytes, CAST(len(t) AS INTEGER) AS n_tok,
             list_concat(t, list_transform(range({BLOCK} - len(t)), lambda x: 0)) AS input_ids FROM f)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, n_tok, md5(array_to_string(input_ids, ',')) AS ids_md5,
       md5(array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ','))
         AS labels_md5
FROM g
""")(tokenize_bytes_q)


def decode_roundtrip(spark, sf):
    docs = _docs(spark, sf)
    ids = T.tokenize_bytes(docs, ["doc_id", "text"], "text", None)
    back = ids.select("doc_id", "text", T.decode_bytes("ids").alias("decoded"))
    return back.select("doc_id", (F.col("decoded") == F.col("text")).alias("exact"),
                       F.length("decoded").cast("bigint").alias("n_chars"))


register("decode_roundtrip", """
SELECT doc_id, true AS exact, CAST(length(text) AS BIGINT) AS n_chars FROM documents
""")(decode_roundtrip)


# ---------------------------------------------------------------------------
# T3 with the piece tokenizer and its vocabulary: decode(tokenize(text)) with
# special ids (pad, unknown) skipped; lossless exactly when no piece is unknown.

def decode_pieces(spark, sf):
    docs = _docs(spark, sf)
    vocab = T.build_vocab(docs, "text", VOCAB, T.PIECE_PATTERN)
    ids = T.tokenize(docs, ["doc_id"], vocab, "text", None, T.PIECE_PATTERN)
    dec = T.decode(ids, ["doc_id"], vocab, "ids")
    return dec.join(docs.select("doc_id", "text"), "doc_id").select(
        "doc_id", (F.col("decoded") == F.col("text")).alias("exact"), F.md5("decoded").alias("decoded_md5"))


register("decode_pieces", f"""
WITH {_vocab_sql(T.PIECE_PATTERN)},
e AS (SELECT doc_id, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM tk),
d AS (SELECT e.doc_id, string_agg(v.token, '' ORDER BY e.pos) AS decoded
      FROM e LEFT JOIN vocab v ON e.tok = v.token GROUP BY e.doc_id)
SELECT tk.doc_id, coalesce(d.decoded, '') = tk.text AS exact, md5(coalesce(d.decoded, '')) AS decoded_md5
FROM tk LEFT JOIN d ON tk.doc_id = d.doc_id
""")(decode_pieces)


# ---------------------------------------------------------------------------
# Batch-dynamic padding, batches of 4 in doc order, cap 50 (benchmark texts).

def pad_batch_q(spark, sf):
    bench = load(spark, sf, "benchmark").select("item_id", "text")
    ids = T.tokenize_bytes(bench, ["item_id"], "text", None)
    b = ids.withColumn("batch", F.floor(F.col("item_id") / 4).cast("bigint"))
    out = T.pad_batch(b, "batch", "ids", 50)
    return out.select("item_id", "batch", "batch_len", _digest("input_ids").alias("ids_md5"),
                      F.aggregate("attention_mask", F.lit(0), lambda a, m: a + m).alias("n_real"))


register("pad_batch", """
WITH b AS (SELECT item_id, CAST(floor(item_id / 4) AS BIGINT) AS batch,
                  list_transform(regexp_extract_all(hex(text), '..', 0), lambda h: CAST(('0x' || h) AS INTEGER) + 2)
                    AS ids FROM benchmark),
m AS (SELECT *, CAST(least(max(len(ids)) OVER (PARTITION BY batch), 50) AS INTEGER) AS batch_len FROM b)
SELECT item_id, batch, batch_len,
       md5(array_to_string(list_concat(ids[1:batch_len],
           list_transform(range(greatest(batch_len - len(ids), 0)), lambda x: 0)), ',')) AS ids_md5,
       CAST(least(len(ids), batch_len) AS INTEGER) AS n_real
FROM m
""")(pad_batch_q)


# ---------------------------------------------------------------------------
# Three tokenizers on the same text, per language.

def tokenizer_compare(spark, sf):
    """Word, piece and byte tokenizers on the same text, per language.
    Counts only, so tokens are pre-aggregated per (lang, token) and never
    rebuilt into id arrays."""
    docs = _docs(spark, sf)
    out = None
    for name, pattern in (("word", T.WORD_PATTERN), ("piece", T.PIECE_PATTERN)):
        per = stored(T.token_counts(docs, ["lang"], "text", pattern), "lang-tokens")      # each text is split once
        c = T.unk_counts(per, ["lang"], T.vocab_of(per, VOCAB))
        part = c.select("lang", F.lit(name).alias("tokenizer"), "n_tokens", "n_unk")
        out = part if out is None else out.unionByName(part)
    chars = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"),
                                     F.sum(F.length("text")).cast("bigint").alias("n_chars"),
                                     F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"))
    by = chars.select("lang", F.lit("bytes").alias("tokenizer"), F.col("n_bytes").alias("n_tokens"),
                      F.lit(0).cast("bigint").alias("n_unk"))
    out = out.unionByName(by)
    return out.join(chars, "lang").select(
        "tokenizer", "lang", "n_docs", "n_tokens", "n_unk",
        F.round(F.col("n_chars") / F.col("n_tokens"), 6).alias("chars_per_token"),
        F.round(F.col("n_unk") / F.col("n_tokens"), 6).alias("unk_rate"))


def _cmp_part(name: str, pattern: str) -> str:
    return f"""
    {name}_tk AS (SELECT doc_id, lang, regexp_extract_all(text, '{pattern}', 0) AS toks FROM documents),
    {name}_cnt AS (SELECT tok, count(*) AS n FROM (SELECT unnest(toks) AS tok FROM {name}_tk) GROUP BY tok),
    {name}_v AS (SELECT tok FROM {name}_cnt ORDER BY n DESC, tok LIMIT {VOCAB}),
    {name}_e AS (SELECT t.lang, u.tok FROM {name}_tk t, unnest(t.toks) AS u(tok)),
    {name}_r AS (SELECT '{name}' AS tokenizer, e.lang, count(*) FILTER (WHERE v.tok IS NULL) AS n_unk, count(*) AS n
                 FROM {name}_e e LEFT JOIN {name}_v v ON e.tok = v.tok GROUP BY e.lang),
    {name}_d AS (SELECT lang, count(*) AS n_docs FROM documents GROUP BY lang)"""


register("tokenizer_compare", f"""
WITH {_cmp_part('word', T.WORD_PATTERN)}, {_cmp_part('piece', T.PIECE_PATTERN)},
ch AS (SELECT lang, count(*) AS n_docs, sum(length(text)) AS n_chars, sum(strlen(text)) AS n_bytes
       FROM documents GROUP BY lang),
allr AS (
  SELECT r.tokenizer, r.lang, r.n AS n_tokens, r.n_unk FROM word_r r
  UNION ALL SELECT r.tokenizer, r.lang, r.n, r.n_unk FROM piece_r r
  UNION ALL SELECT 'bytes', lang, n_bytes, 0 FROM ch)
SELECT a.tokenizer, a.lang, ch.n_docs, CAST(a.n_tokens AS BIGINT) AS n_tokens, CAST(a.n_unk AS BIGINT) AS n_unk,
       round(ch.n_chars / a.n_tokens, 6) AS chars_per_token, round(a.n_unk / a.n_tokens, 6) AS unk_rate
FROM allr a JOIN ch ON a.lang = ch.lang
""")(tokenizer_compare)


# ---------------------------------------------------------------------------
# B1 label mask with a genuine EOS appended (reference masks it too), and the
# position-based alternative; B3 next-token pairs.

MASK_BLOCK = 1024


def label_mask(spark, sf):
    """B1 with a genuine EOS after the text: the reference mask (every pad/eos
    id) and the position mask, from one row fitted to the block."""
    from skein.functions.arrays import mask_by_position
    docs = _docs(spark, sf)
    # no more bytes than the block holds are split; a longer text loses its end token to the cut
    ids = docs.select("doc_id", F.concat(T.byte_ids("text", MASK_BLOCK), F.array(F.lit(T.EOS_ID))).alias("ids"))
    ref = T.fit(ids, "ids", MASK_BLOCK, mask="pad_id")
    return ref.select("doc_id", "n_tok",
                      F.size(F.filter("labels", lambda x: x == -100)).alias("masked_ref"),
                      F.size(F.filter(mask_by_position("input_ids", "attention_mask"), lambda x: x == -100))
                      .alias("masked_pos"),
                      _digest("labels").alias("labels_md5"))


register("label_mask", f"""
WITH b AS (SELECT doc_id, list_append(list_transform(regexp_extract_all(hex(text), '..', 0),
                  lambda h: CAST(('0x' || h) AS INTEGER) + 2), 0)[1:{MASK_BLOCK}] AS ids FROM documents),
g AS (SELECT doc_id, CAST(len(ids) AS INTEGER) AS n_tok,
             list_concat(ids, list_transform(range({MASK_BLOCK} - len(ids)), lambda x: 0)) AS input_ids FROM b)
SELECT doc_id, n_tok, CAST(len(list_filter(input_ids, lambda x: x = 0)) AS INTEGER) AS masked_ref,
       CAST({MASK_BLOCK} - n_tok AS INTEGER) AS masked_pos,
       md5(array_to_string(list_transform(input_ids, lambda x: CASE WHEN x = 0 THEN -100 ELSE x END), ','))
         AS labels_md5
FROM g
""")(label_mask)


def shift_labels(spark, sf):
    bench = load(spark, sf, "benchmark").select("item_id", "text")
    ids = T.tokenize_bytes(bench, ["item_id"], "text", None)          # whole texts, end token masked
    labels = ids.select("item_id", mask_pad(F.concat("ids", F.array(F.lit(T.EOS_ID)))).alias("labels"))
    pairs = T.next_token_pairs(labels, ["item_id"], "labels")
    return pairs.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(F.col("target") != -100).alias("n_valid"),
        F.sum(F.when(F.col("target") != -100, F.col("target") * (F.col("pos") + 1))).cast("bigint").alias("checksum"))


register("shift_labels", """
WITH b AS (SELECT item_id, list_transform(regexp_extract_all(hex(text), '..', 0),
                  lambda h: CAST(('0x' || h) AS INTEGER) + 2) AS ids FROM benchmark),
g AS (SELECT item_id, list_append(ids, -100) AS labels FROM b),
p AS (SELECT item_id, unnest(labels[2:]) AS target, generate_subscripts(labels[2:], 1) - 1 AS pos FROM g)
SELECT item_id, count(*) AS n_pairs, count(*) FILTER (WHERE target <> -100) AS n_valid,
       CAST(sum(CASE WHEN target <> -100 THEN target * (pos + 1) END) AS BIGINT) AS checksum
FROM p GROUP BY item_id
""")(shift_labels)


# ---------------------------------------------------------------------------
# T7 (BPE): the oracle unrolls the merges into one CTE each. Symbols stand
# between two marks, so a merge is a plain string replacement.

MERGES = 8


def bpe_merges(spark, sf):
    from skein.operators.bpe import learn_bpe
    return learn_bpe(_docs(spark, sf), MERGES, "text")


def _bpe_sql() -> str:
    steps, out = [], []
    for i in range(MERGES):
        steps.append(f"""
p{i} AS (SELECT l, r, CAST(sum(c) AS BIGINT) AS n FROM (
      SELECT c, unnest(y[:-2]) AS l, unnest(y[2:]) AS r
      FROM (SELECT c, regexp_extract_all(s, '\x01([^\x02]*)\x02', 1) AS y FROM w{i}) WHERE len(y) > 1)
    GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1),
w{i + 1} AS MATERIALIZED (SELECT c, replace(s, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || r || chr(2)) AS s
    FROM w{i}, p{i})""")
        out.append(f"SELECT CAST({i} AS INTEGER) AS rank, l AS \"left\", r AS \"right\", n FROM p{i}")
    return f"""
WITH w0 AS MATERIALIZED (SELECT count(*) AS c, regexp_replace(word, '(.)', chr(1) || '\\1' || chr(2), 'gs') AS s
       FROM (SELECT unnest(regexp_extract_all(text, '{T.WORD_PATTERN}', 0)) AS word FROM documents) GROUP BY word),
{','.join(steps)}
{' UNION ALL '.join(out)}"""


register("bpe_merges", _bpe_sql())(bpe_merges)


# ---------------------------------------------------------------------------
# Texts encoded with a learnt BPE, and read back from the ids. The oracle unrolls the merges.

ENCODE_MERGES = 24


def bpe_encode(spark, sf):
    from skein.operators import bpe
    docs = _docs(spark, sf)
    merges, vocab = bpe.train_bpe(docs, ENCODE_MERGES)
    ids = bpe.encode_bpe(docs, ["doc_id"], merges, vocab, "text", T.PIECE_PATTERN)
    back = T.decode(ids, ["doc_id", "ids"], vocab)
    return back.select("doc_id", F.size("ids").alias("n_tok"), _digest("ids").alias("ids_md5"),
                       F.md5("decoded").alias("text_md5"))


def _encode_sql() -> str:
    steps = []
    for i in range(ENCODE_MERGES):
        steps.append(f"""
p{i} AS MATERIALIZED (SELECT l, r, CAST(sum(c) AS BIGINT) AS n FROM (
      SELECT c, unnest(y[:-2]) AS l, unnest(y[2:]) AS r
      FROM (SELECT c, regexp_extract_all(s, '\x01([^\x02]*)\x02', 1) AS y FROM w{i}) WHERE len(y) > 1)
    GROUP BY l, r ORDER BY n DESC, l, r LIMIT 1),
w{i + 1} AS MATERIALIZED (SELECT word, c, replace(s, chr(1) || l || chr(2) || chr(1) || r || chr(2), chr(1) || l || r || chr(2)) AS s
    FROM w{i}, p{i})""")
    made = " UNION ALL ".join(f"SELECT {i} AS k, l || r AS token FROM p{i}" for i in range(ENCODE_MERGES))
    return f"""
WITH t AS (SELECT doc_id, text, regexp_extract_all(text, '{T.PIECE_PATTERN}', 0) AS ws FROM documents),
w0 AS MATERIALIZED (SELECT word, count(*) AS c, regexp_replace(word, '(.)', chr(1) || '\\1' || chr(2), 'gs') AS s
       FROM (SELECT unnest(ws) AS word FROM t) GROUP BY word),
{','.join(steps)},
ch AS (SELECT token, sum(c) AS n FROM (SELECT unnest(string_split(word, '')) AS token, c FROM w0) GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY k, n DESC, token) + 1 AS id FROM (
      SELECT token, -1 AS k, n FROM ch UNION ALL SELECT token, min(k), 0 FROM ({made}) GROUP BY token)),
e AS (SELECT word, p, token FROM (SELECT word, unnest(y) AS token, generate_subscripts(y, 1) AS p
      FROM (SELECT word, regexp_extract_all(s, '\x01([^\x02]*)\x02', 1) AS y FROM w{ENCODE_MERGES}))),
i AS (SELECT word, list(coalesce(id, 1) ORDER BY p) AS ids FROM e LEFT JOIN v USING (token) GROUP BY word),
u AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS q FROM t),
o AS (SELECT doc_id, flatten(list(ids ORDER BY q)) AS ids FROM u JOIN i USING (word) GROUP BY doc_id)
SELECT t.doc_id, CAST(coalesce(len(ids), 0) AS INTEGER) AS n_tok, md5(coalesce(array_to_string(ids, ','), '')) AS ids_md5,
       md5(text) AS text_md5
FROM t LEFT JOIN o USING (doc_id)"""


register("bpe_encode", _encode_sql())(bpe_encode)
