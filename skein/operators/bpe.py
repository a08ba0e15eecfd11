"""Byte-pair-encoding merge learning on the corpus word-count table.

The corpus is reduced once to distinct words with counts (map-side partial
aggregation); a word is stored as its symbols, each between two marks, so a
merge is one plain string replacement, left to right.

A round takes a whole prefix of the pair ranking, not one merge: a pair that
shares no symbol with the merges before it keeps its count, and a pair made
by a merge counts at most as much as an old pair with one of its symbols, so
it cannot outrank the prefix as long as the prefix ends before such a pair (and
before a tie with one). Pair counts are kept up incrementally: only words that
contain a merged pair change, so a round subtracts their old pairs and adds
their new ones. Each round writes its two tables under
``spark.checkpoint.dir`` and deletes those of the round before.

Encoding applies the merges in their order to every distinct word of an Arrow
batch: the word's symbols are a linked list, and a priority queue of (rank, place)
gives the next merge, so a word of n symbols takes O(n log n) steps whatever
the number of merges. Ids are joined back to the words inside the batch, and a worker
keeps the words it has seen, so neither texts nor tokens are shuffled.
"""

from __future__ import annotations

import os
import uuid
from bisect import bisect_right
from collections.abc import Sequence
from heapq import heapify, heappop, heappush

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.operators.tokens import FIRST_WORD_ID, PIECE_PATTERN, UNK_ID, WORD_PATTERN, split_tokens, token_counts
from skein.session import bound_batches, checkpoint_dir, stored

OPEN, CLOSE = "\u0001", "\u0002"  # marks around a symbol (never produced by the tokenizer patterns)
RANKED = 512                      # pairs looked at per round, at most
SEEN_WORDS = 1 << 18              # words whose ids a worker keeps, at most


def _unit(symbol: str) -> str:
    return f"{OPEN}{symbol}{CLOSE}"


def word_symbols(df: DataFrame, text: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """(word, c, s): distinct words with counts; ``s`` = the marked characters."""
    wc = token_counts(df, [], text, pattern).withColumnRenamed("token", "word")
    marked = F.concat(F.lit(OPEN), F.array_join(F.split(F.col("word"), ""), CLOSE + OPEN), F.lit(CLOSE))
    return wc.select("word", F.col("c").cast("bigint").alias("c"), marked.alias("s"))


def apply_merge(s: Column, left: str, right: str) -> Column:
    """Replace adjacent (left, right) symbols by left+right, left to right."""
    return F.replace(s, F.lit(_unit(left) + _unit(right)), F.lit(_unit(left + right)))


def pair_rows(words: DataFrame, sign: int = 1) -> DataFrame:
    """(left, right, c) for every adjacent pair, weighted by sign * count."""
    syms = F.split(F.substr("s", F.lit(2), F.length("s") - 2), CLOSE + OPEN)
    k = F.greatest(F.size(syms) - 1, F.lit(0))
    z = F.arrays_zip(F.slice(syms, 1, k).alias("l"), F.slice(syms, 2, k).alias("r"))
    return words.select((F.col("c") * sign).alias("c"), F.explode(z).alias("p")) \
                .select(F.col("p.l").alias("left"), F.col("p.r").alias("right"), "c")


def pair_counts(words: DataFrame) -> DataFrame:
    return pair_rows(words).groupBy("left", "right").agg(F.sum("c").cast("bigint").alias("n"))


def safe_prefix(ranked: list[tuple[str, str, int]], complete: bool) -> int:
    """How many leading pairs of the ranking are the next merges for sure.

    ``ranked`` is in merge order; ``complete`` tells that no pair is left out."""
    used: set[str] = set()
    i = 0
    while i < len(ranked):
        n = ranked[i][2]
        j = i
        while j < len(ranked) and ranked[j][2] == n:
            j += 1
        if j == len(ranked) and not complete:                       # the tie may go on unseen
            break
        if any({left, right} & used for left, right, _ in ranked[i:j]):
            break
        for k in range(i, j):
            used |= set(ranked[k][:2])
            if any({left, right} & used for left, right, _ in ranked[k + 1:j]):
                return k + 1
        i = j
    return max(i, min(1, len(ranked)))                              # the top pair is always next


def _drop(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def learn_bpe(df: DataFrame, n_merges: int, text: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """T7 (BPE): the first ``n_merges`` merges as (rank, left, right, n), ties by left, then right symbol."""
    spark = df.sparkSession
    base = os.path.join(checkpoint_dir(spark), f"bpe-{uuid.uuid4().hex[:12]}")

    def materialise(d: DataFrame, name: str) -> DataFrame:
        path = os.path.join(base, name)
        d.write.mode("overwrite").parquet(path)
        return spark.read.schema(d.schema).parquet(path)

    words = materialise(word_symbols(df, text, pattern).filter(F.col("s").contains(CLOSE + OPEN)), "words-0")
    counts = materialise(pair_counts(words), "pairs-0")
    merges: list[tuple[int, str, str, int]] = []
    turn = 0
    while len(merges) < n_merges:
        top = counts.orderBy(F.desc("n"), "left", "right").limit(RANKED).collect()
        ranked = [(r["left"], r["right"], int(r["n"])) for r in top]
        take = ranked[:min(safe_prefix(ranked, len(ranked) < RANKED), n_merges - len(merges))]
        if not take:
            break
        merges += [(len(merges) + i, *p) for i, p in enumerate(take)]
        if len(merges) >= n_merges:
            break
        hit, merged = F.lit(False), F.col("s")
        for left, right, _ in take:
            hit = hit | F.col("s").contains(_unit(left) + _unit(right))
            merged = apply_merge(merged, left, right)
        affected = words.filter(hit)
        delta = pair_rows(affected, -1).unionByName(pair_rows(affected.withColumn("s", merged), 1)) \
            .groupBy("left", "right").agg(F.sum("c").alias("d"))
        turn += 1
        counts = materialise(
            counts.join(delta, ["left", "right"], "full")
                  .select("left", "right",
                          (F.coalesce("n", F.lit(0)) + F.coalesce("d", F.lit(0))).cast("bigint").alias("n"))
                  .filter(F.col("n") > 0), f"pairs-{turn}")
        words = materialise(words.withColumn("s", merged).filter(F.col("s").contains(CLOSE + OPEN)), f"words-{turn}")
        for name in ("pairs", "words"):
            _drop(spark, os.path.join(base, f"{name}-{turn - 1}"))
    _drop(spark, base)
    return spark.createDataFrame(merges, "rank int, left string, right string, n long")


def bpe_vocab(df: DataFrame, merges: DataFrame, text: str = "text", pattern: str = WORD_PATTERN) -> DataFrame:
    """(token, id, n): the characters of the corpus by count, then the merged symbols by rank (once each).

    ``n`` counts characters, or pairs at the time of their merge. The table has a row per character and merge, so
    the numbering in one task is bounded by Unicode and the number of merges."""
    words = token_counts(df, [], text, pattern)
    chars = words.select(F.explode(F.split("token", "")).alias("token"), "c").filter("token <> ''") \
        .groupBy("token").agg(F.sum("c").cast("bigint").alias("n")).withColumn("rank", F.lit(-1))
    made = merges.select(F.concat("left", "right").alias("token"), F.col("n").cast("bigint").alias("n"), "rank") \
        .groupBy("token").agg(F.min_by("n", "rank").alias("n"), F.min("rank").alias("rank"))
    order = Window.orderBy("rank", F.desc(F.when(F.col("rank") < 0, F.col("n"))), "token")
    return chars.unionByName(made).select(
        "token", (F.row_number().over(order) + F.lit(FIRST_WORD_ID - 1)).cast("int").alias("id"), "n")


def merge_word(word: str, ranks: dict[tuple[str, str], list[int]]) -> list[str]:
    """The symbols of a word after all merges, each applied from left to right in the order of ranks.

    ``ranks`` holds the ranks of each pair in ascending order (a pair may be merged again later, after other
    merges have made it anew)."""
    sym: list[str | None] = list(word)
    n = len(sym)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    queue = [(ranks[sym[i], sym[i + 1]][0], i, sym[i], sym[i + 1]) for i in range(n - 1) if (sym[i], sym[i + 1]) in ranks]
    heapify(queue)
    while queue:
        rank, i, left, right = heappop(queue)
        j = after[i]
        if sym[i] != left or j >= n or sym[j] != right:
            continue                                              # one of the two has been merged since
        sym[i], sym[j] = left + right, None
        after[i] = k = after[j]
        if k < n:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b < n:
                later = ranks.get((sym[a], sym[b]), ())
                at = bisect_right(later, rank)
                if at < len(later):
                    heappush(queue, (later[at], a, sym[a], sym[b]))
    return [s for s in sym if s is not None]


def encode_bpe(df: DataFrame, keys: Sequence[str], merges: DataFrame, vocab: DataFrame, text: str = "text",
               pattern: str = WORD_PATTERN) -> DataFrame:
    """T1 with a trained BPE: (keys, ids), symbols that the vocabulary lacks become ``UNK_ID``; NULL text has no ids.

    Merges and vocabulary are collected once: their size is that of the learnt tokenizer, not of the data. With
    ``pattern=PIECE_PATTERN`` the pieces keep their spaces, and ``tokens.decode`` gives back the text."""
    ranks: dict[tuple[str, str], list[int]] = {}
    for r in merges.select("rank", "left", "right").orderBy("rank").collect():
        ranks.setdefault((r["left"], r["right"]), []).append(r["rank"])
    shared = df.sparkSession.sparkContext.broadcast((ranks, {r["token"]: r["id"] for r in vocab.select("token", "id").collect()}))
    bound_batches(df.sparkSession)
    base = df.select(*keys, split_tokens(text, pattern).alias("_words"))
    out = T.StructType([*base.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc
        ranks, number = shared.value
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            col = b.column(b.num_columns - 1)
            words = pc.dictionary_encode(col.flatten())
            codes = words.indices.to_numpy(zero_copy_only=False)
            parts = []
            if len(seen) > SEEN_WORDS:
                seen.clear()
            for w in words.dictionary.to_pylist():
                ids = seen.get(w)
                if ids is None:
                    ids = seen[w] = np.array([number.get(s, UNK_ID) for s in merge_word(w, ranks)], np.int32)
                parts.append(ids)
            size = np.array([len(p) for p in parts], np.int64)
            start = np.concatenate([[0], np.cumsum(size)])
            flat = np.concatenate([np.zeros(0, np.int32), *parts])
            each = size[codes] if len(codes) else size[:0]
            ends = np.concatenate([[0], np.cumsum(each)])
            ids = flat[np.arange(ends[-1]) - np.repeat(ends[:-1] - start[codes], each)] if ends[-1] else flat[:0]
            row = np.concatenate([[0], np.cumsum(pc.list_value_length(col).to_numpy(zero_copy_only=False))]).astype(np.int64)
            lists = pa.ListArray.from_arrays(pa.array(ends[row].astype(np.int32)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], names=[*b.schema.names[:-1], "ids"])

    return base.mapInArrow(run, out)


def train_bpe(df: DataFrame, n_merges: int, text: str = "text", pattern: str = PIECE_PATTERN) -> tuple[DataFrame, DataFrame]:
    """(merges, vocabulary) learnt from the texts; both are small tables of the tokenizer's size."""
    merges = learn_bpe(df, n_merges, text, pattern)
    return merges, stored(bpe_vocab(df, merges, text, pattern), "bpe-vocab")
