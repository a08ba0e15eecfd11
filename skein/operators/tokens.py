"""Tokenization of a table (T1-T8), fit to length (P8) and label masks.

``regexp_extract_all`` splits text on the JVM and the vocabulary is a table
built from the corpus (T7). Ids are found by Arrow's hash lookup against a
broadcast of the vocabulary, one batch of token lists at a time, so texts and
tokens are never shuffled; decoding works the same way. A vocabulary whose
measured bytes exceed ``LOCAL_VOCAB_BYTES`` is joined by shuffle instead, one
row per token. Text is truncated *before* the lookup in padded mode.

Byte path: UTF-8 bytes via ``hex``; no vocabulary, no shuffle, lossless.
User tokenizers (T8) run in ``skein.operators.infer.tokenize_with``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.arrays import attention_mask, fit_length, mask_pad
from skein.session import bound_batches, stored

# --- fixed values -----------------------------------------------------------
# Token ids: end-of-text doubles as padding (pad := eos when the tokenizer has
# no pad token); unknown words map to 1; vocabulary words start at 2.
EOS_ID = 0
PAD_ID = 0
UNK_ID = 1
FIRST_WORD_ID = 2
# Word pattern: runs of letters, runs of digits, runs of other non-space chars.
WORD_PATTERN = r"\p{L}+|\p{N}+|[^\s\p{L}\p{N}]+"
# Piece pattern: as above with one optional leading space; whitespace runs kept,
# so concatenating the pieces gives back the text.
PIECE_PATTERN = r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"
# Byte ids: byte value + FIRST_WORD_ID (2..257).
BYTE_OFFSET = FIRST_WORD_ID
# ----------------------------------------------------------------------------

LOCAL_VOCAB_BYTES = 64 << 20


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def split_tokens(text, pattern: str = WORD_PATTERN) -> Column:
    """array<string> of pattern matches; NULL text gives an empty array."""
    return F.coalesce(F.regexp_extract_all(_c(text), F.lit(pattern), 0),
                      F.array().cast("array<string>"))


def byte_ids(text, max_len: int | None = None) -> Column:
    """array<int> of UTF-8 byte ids (byte + 2).

    The UTF-8 bytes are re-read as ISO-8859-1 (one character per byte) and
    split into characters, whose code points are the byte values. With
    ``max_len`` only a prefix of the text is split: the first n characters
    hold at least n bytes.
    """
    t = F.coalesce(_c(text), F.lit(""))
    if max_len is not None:
        t = F.substring(t, 1, max_len)
    latin = F.decode(F.encode(t, "UTF-8"), "ISO-8859-1")
    chars = F.split(latin, "")
    ids = F.transform(chars, lambda ch: F.ascii(ch) + F.lit(BYTE_OFFSET))
    if max_len is not None:
        ids = F.slice(ids, 1, max_len)
    return F.when(F.length(latin) == 0, F.array().cast("array<int>")).otherwise(ids)


def decode_bytes(ids) -> Column:
    """Inverse of ``byte_ids`` (T3 for the byte tokenizer); pad ids skipped.
    Byte values become ISO-8859-1 characters, re-encoded and read as UTF-8."""
    real = F.filter(_c(ids), lambda x: x >= F.lit(BYTE_OFFSET))
    latin = F.array_join(F.transform(real, lambda x: F.chr(x - F.lit(BYTE_OFFSET))), "")
    return F.decode(F.encode(latin, "ISO-8859-1"), "UTF-8")


def build_vocab(df: DataFrame, text: str = "text", size: int = 8192,
                pattern: str = WORD_PATTERN) -> DataFrame:
    """Vocabulary (token, id, n): the ``size`` most frequent tokens, ties by token.

    Word count with map-side partial aggregation, written once. The top-``size``
    step first finds a count that at least ``size`` tokens reach, by a few
    64-bin histograms of the counts, so the ordered top-k sees ``size`` rows
    plus those close to or tied with the last one instead of ``size`` rows
    from every partition of the distinct-token table.
    """
    return vocab_of(token_counts(df, [], text, pattern), size)


def vocab_of(counted: DataFrame, size: int) -> DataFrame:
    """``build_vocab`` from ``token_counts``, which may be split by further groups."""
    counts = stored(counted.groupBy("token").agg(F.sum("c").cast("bigint").alias("n")), "token-counts")
    cand = counts.filter(F.col("n") >= count_floor(counts, size))
    top = cand.select("token", "n").orderBy(F.desc("n"), F.asc("token")).limit(size)
    # ``size`` rows at most: a single ordered task is bounded by the parameter.
    w = Window.orderBy(F.desc("n"), F.asc("token"))
    return top.select("token", (F.row_number().over(w) + F.lit(FIRST_WORD_ID - 1)).cast("int").alias("id"),
                      F.col("n").cast("bigint").alias("n"))


def count_floor(counts: DataFrame, size: int, bins: int = 64) -> int:
    """A count that at least ``size`` tokens reach, and not many more: the range
    of counts is cut into ``bins`` and the bin where the tail passes ``size``
    is cut again (1 if there are no more than ``size`` tokens)."""
    head = counts.agg(F.max("n").alias("top"), F.count(F.lit(1)).alias("k")).first()
    if head["k"] <= size:
        return 1
    lo, hi, above = 1, head["top"] + 1, 0          # above: tokens with n >= hi
    while hi - lo > 1:
        width = -(-(hi - lo) // bins)
        rows = counts.filter((F.col("n") >= lo) & (F.col("n") < hi)) \
            .groupBy(F.floor((F.col("n") - lo) / F.lit(width)).alias("b")).agg(F.count(F.lit(1)).alias("k")).collect()
        for r in sorted(rows, key=lambda r: -r["b"]):                      # at most ``bins`` rows
            at = lo + r["b"] * width
            if above + r["k"] >= size:
                lo, hi = at, min(hi, at + width)
                break
            above += r["k"]
        else:
            return lo
        if above + r["k"] <= 2 * size:
            break
    return lo


def local_vocab(vocab: DataFrame):
    """The vocabulary as an Arrow table (token, id), or None if its measured
    bytes exceed ``LOCAL_VOCAB_BYTES``. Measured and read once per DataFrame."""
    if "_skein_local" not in vocab.__dict__:
        v = stored(vocab.select("token", "id"), "vocab")
        size = v.agg(F.sum(F.octet_length("token") + 8)).first()[0] or 0
        vocab.__dict__["_skein_local"] = v.toArrow() if size <= LOCAL_VOCAB_BYTES else None
    return vocab.__dict__["_skein_local"]


def token_ids(df: DataFrame, keys: Sequence[str], vocab: DataFrame, text: str = "text",
              pattern: str = WORD_PATTERN, max_len: int | None = None) -> DataFrame:
    """(keys..., n_raw, ids): ids of every row's first ``max_len`` tokens."""
    table = local_vocab(vocab)
    if table is None:
        return collect_ids(token_ids_long(df, keys, vocab, text, pattern, max_len), keys)
    bound_batches(df.sparkSession)
    toks = df.select(*keys, split_tokens(text, pattern).alias("_toks"))
    toks = toks.select(*keys, F.size("_toks").alias("n_raw"),
                       (F.slice("_toks", 1, max_len) if max_len else F.col("_toks")).alias("_toks"))
    shared = df.sparkSession.sparkContext.broadcast(table)
    out = T.StructType([*toks.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        words = shared.value.column("token").combine_chunks()
        ids = shared.value.column("id").combine_chunks().cast(pa.int32())
        for b in batches:
            col = b.column(b.num_columns - 1)
            found = pc.fill_null(pc.take(ids, pc.index_in(col.flatten(), value_set=words)), UNK_ID)
            size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.ListArray.from_arrays(pa.array(cut), found)],
                                             names=[*b.schema.names[:-1], "ids"])

    return toks.mapInArrow(run, out)


def token_ids_long(df: DataFrame, keys: Sequence[str], vocab: DataFrame, text: str = "text",
                   pattern: str = WORD_PATTERN, max_len: int | None = None) -> DataFrame:
    """One row per kept token: (keys..., n_raw, pos, id); pos 0-based. The form
    for a vocabulary too large to hand to every task.

    Rows with no token keep one row with NULL pos/id so they are not lost.
    """
    toks = split_tokens(text, pattern)
    base = df.select(*keys, toks.alias("_toks"))
    base = base.select(*keys, F.size("_toks").alias("n_raw"),
                       (F.slice("_toks", 1, max_len) if max_len else F.col("_toks")).alias("_toks"))
    ex = base.select(*keys, "n_raw", F.posexplode_outer("_toks").alias("pos", "token"))
    j = ex.join(vocab.select("token", "id"), "token", "left")
    return j.select(*keys, "n_raw", F.col("pos").cast("int").alias("pos"),
                    F.when(F.col("pos").isNotNull(), F.coalesce("id", F.lit(UNK_ID))).cast("int").alias("id"))


def collect_ids(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rebuild (keys..., n_raw, ids) from long form, in token order.

    Each (pos, id) is packed into one long, pos in the high bits, so ordering
    is a primitive sort instead of a struct sort."""
    packed = F.col("pos").cast("long") * F.lit(1 << 32) + F.col("id")
    g = long.groupBy(*keys).agg(F.max("n_raw").alias("n_raw"),
                                F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), packed))).alias("_p"))
    return g.select(*keys, "n_raw", F.transform("_p", lambda x: (x % F.lit(1 << 32)).cast("int")).alias("ids"))


def token_counts(df: DataFrame, by: Sequence[str], text: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """(by..., token, c): occurrences per group and token. Map-side partial
    aggregation shrinks a hot token to one row per task before the shuffle;
    joins with a vocabulary then see distinct (group, token) pairs only."""
    ex = df.select(*by, F.explode(split_tokens(text, pattern)).alias("token"))
    return ex.groupBy(*by, "token").agg(F.count(F.lit(1)).alias("c"))


def unk_counts(counts: DataFrame, by: Sequence[str], vocab: DataFrame) -> DataFrame:
    """(by..., n_tokens, n_unk, n_distinct_ids) from ``token_counts``."""
    j = counts.join(vocab.select("token", "id"), "token", "left")
    return j.groupBy(*by).agg(F.sum("c").cast("bigint").alias("n_tokens"),
                              F.sum(F.when(F.col("id").isNull(), F.col("c")).otherwise(0)).cast("bigint")
                              .alias("n_unk"),
                              F.count_distinct(F.coalesce("id", F.lit(UNK_ID))).alias("n_distinct_ids"))


def fit(df: DataFrame, ids: str = "ids", block_size: int = 512, pad_id: int = PAD_ID,
        mask: str = "pad_id") -> DataFrame:
    """Truncate/pad ``ids`` to ``block_size`` with mask and labels.

    ``mask='pad_id'`` (reference): every id equal to pad becomes -100, so a
    genuine EOS is masked too. ``mask='position'``: only padded positions.
    """
    n_tok = F.least(F.size(ids), F.lit(block_size))
    out = df.withColumn("n_tok", n_tok.cast("int")) \
            .withColumn("input_ids", fit_length(ids, block_size, pad_id)) \
            .withColumn("attention_mask", attention_mask("n_tok", block_size))
    if mask == "position":
        from skein.functions.arrays import mask_by_position
        return out.withColumn("labels", mask_by_position("input_ids", "attention_mask"))
    return out.withColumn("labels", mask_pad("input_ids", pad_id))


def tokenize(df: DataFrame, keys: Sequence[str], vocab: DataFrame, text: str = "text",
             block_size: int | None = 512, pattern: str = WORD_PATTERN, pad_id: int = PAD_ID,
             mask: str = "pad_id") -> DataFrame:
    """Tokenize, truncate to ``block_size`` and right-pad to exactly it.

    Source columns other than ``keys`` are dropped (P6). ``block_size=None``
    returns the raw ``ids`` (for packing) without padding.
    """
    ids = token_ids(df, keys, vocab, text, pattern, block_size)
    if block_size is None:
        return ids.withColumn("n_tok", F.size("ids"))
    return fit(ids, "ids", block_size, pad_id, mask).drop("ids")


def tokenize_bytes(df: DataFrame, keys: Sequence[str], text: str = "text",
                   block_size: int | None = 512, pad_id: int = PAD_ID) -> DataFrame:
    """Byte tokenizer: a pure projection, no shuffle. In padded mode only the
    first ``block_size`` characters are split; n_raw is the full byte length."""
    if block_size is None:
        out = df.select(*keys, byte_ids(text).alias("ids"))
        return out.withColumn("n_raw", F.size("ids")).withColumn("n_tok", F.col("n_raw"))
    out = df.select(*keys, byte_ids(text, block_size).alias("ids"),
                    F.octet_length(F.coalesce(F.col(text), F.lit(""))).alias("n_raw"))
    return fit(out, "ids", block_size, pad_id).drop("ids")


def decode(df: DataFrame, keys: Sequence[str], vocab: DataFrame, ids: str = "ids",
           skip_special: bool = True, sep: str = "") -> DataFrame:
    """T3 for a vocabulary tokenizer: ids -> text (special ids skipped, ids
    without a token become ``<unk>``)."""
    table = local_vocab(vocab)
    if table is None:
        return _decode_long(df, keys, vocab, ids, skip_special, sep)
    bound_batches(df.sparkSession)
    base = df.select(*keys, F.coalesce(F.col(ids), F.array().cast("array<int>")).cast("array<int>").alias("_ids"))
    shared = df.sparkSession.sparkContext.broadcast(table)
    out = T.StructType([*base.schema.fields[:-1], T.StructField("decoded", T.StringType())])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        number = shared.value.column("id").to_numpy()
        words = shared.value.column("token").combine_chunks()
        place = np.full(int(number.max(initial=0)) + 1, -1)
        place[number] = np.arange(len(number))
        for b in batches:
            col = b.column(b.num_columns - 1)
            flat = pc.fill_null(col.flatten(), -1).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(col).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            if skip_special:
                row, flat = row[flat >= FIRST_WORD_ID], flat[flat >= FIRST_WORD_ID]
            at = np.where((flat >= 0) & (flat < len(place)), place[np.clip(flat, 0, len(place) - 1)], -1)
            text = pc.fill_null(pc.take(words, pa.array(at, mask=at < 0)), "<unk>")
            cut = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(size)))]).astype(np.int32)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cut), text), sep)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], joined.cast(pa.string())],
                                             names=[*b.schema.names[:-1], "decoded"])

    return base.mapInArrow(run, out)


def _decode_long(df: DataFrame, keys: Sequence[str], vocab: DataFrame, ids: str, skip_special: bool,
                 sep: str) -> DataFrame:
    """``decode`` for a vocabulary too large to hand to every task: one row per id."""
    ex = df.select(*keys, F.posexplode_outer(ids).alias("pos", "id"))
    if skip_special:
        ex = ex.withColumn("pos", F.when(F.col("id") >= FIRST_WORD_ID, F.col("pos")))
    j = ex.join(vocab.select("token", "id"), "id", "left")
    g = j.groupBy(*keys).agg(F.array_sort(F.collect_list(
        F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token", F.lit("<unk>")).alias("tok"))))).alias("_p"))
    return g.select(*keys, F.array_join(F.transform("_p", lambda s: s["tok"]), sep).alias("decoded"))


def pad_batch(df: DataFrame, batch: str, ids: str = "ids", cap: int = 50, pad_id: int = PAD_ID) -> DataFrame:
    """Pad every row to the longest row of its batch, at most ``cap``.

    The window is partitioned by batch, whose size is a parameter (bounded).
    """
    longest = F.least(F.max(F.size(ids)).over(Window.partitionBy(batch)), F.lit(cap))
    out = df.withColumn("batch_len", longest.cast("int"))
    padded = F.concat(F.slice(ids, 1, F.col("batch_len")),
                      F.array_repeat(F.lit(pad_id), F.greatest(F.lit(0), F.col("batch_len") - F.size(ids))))
    k = F.least(F.size(ids), F.col("batch_len"))
    am = F.concat(F.array_repeat(F.lit(1).cast("tinyint"), k),
                  F.array_repeat(F.lit(0).cast("tinyint"), F.col("batch_len") - k))
    return out.withColumn("input_ids", padded).withColumn("attention_mask", am)


def next_token_pairs(df: DataFrame, keys: Sequence[str], labels: str = "labels") -> DataFrame:
    """B3 long form: (keys..., pos, target) with target = labels[pos+1].

    Exploding one row's array keeps all work inside that row: no window, no
    shuffle; pairs whose target is -100 are kept (the loss ignores them).
    """
    shifted = F.slice(labels, 2, F.greatest(F.size(labels) - 1, F.lit(0)))
    return df.select(*keys, F.posexplode(shifted).alias("pos", "target"))
