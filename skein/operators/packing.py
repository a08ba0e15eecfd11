"""Packing token streams into fixed-size blocks (K1, K2).

Within a pack group the rows' token lists are concatenated in row order and
cut into ``block_size`` chunks; the short tail is dropped when the group holds
at least one full block, otherwise the group yields one short block; an empty
group yields none.

Plan: per row, its token offset inside the group (running sum of row lengths)
-> the row's lists are sliced at block edges, one row per (row, block) piece ->
group by (group, block) and join the pieces in order. What is shuffled are
pieces of rows, not tokens, and a block holds at most ``block_size`` tokens,
so no group is unbounded. With bounded pack groups the running sum is a window
partitioned by group; with ``rows_per_group=None`` the whole corpus is one
group and the running sum is the bucketed prefix sum (no single-task window).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ordering import global_index, prefix_sum
from skein.operators.tokens import WORD_PATTERN, token_ids


def assign_pack_groups(df: DataFrame, by: Sequence[str], rows_per_group: int | None) -> DataFrame:
    """K2: pack_group = position div rows_per_group (consecutive row batches)."""
    if rows_per_group is None:
        return df.withColumn("pack_group", F.lit(0).cast("bigint"))
    ix = global_index(df, by, name="_skein_pos")
    return ix.withColumn("pack_group", F.floor(F.col("_skein_pos") / rows_per_group).cast("bigint")) \
             .drop("_skein_pos")


def pack_lists(df: DataFrame, lists: Sequence[str] | Mapping[str, Column], by: Sequence[str], block_size: int,
               rows_per_group: int | None = 1000) -> DataFrame:
    """K1/K2 on every list column in ``lists``, cut at the same places.

    The columns of a row have equal lengths (ids, mask, labels of the same
    tokens); a NULL list counts as empty. ``lists`` may map names to expressions over ``df``: the shuffles then move
    the columns of ``df`` (a text, say), and the lists are made where they are cut.
    Returns (pack_group, block, <lists>..., n_tok)."""
    made = dict(lists) if isinstance(lists, Mapping) else {}
    lists = list(lists)
    rows = assign_pack_groups(df if made else df.select(*by, *lists), by, rows_per_group)
    rows = rows.withColumn("_skein_n", F.coalesce(F.size(made.get(lists[0], F.col(lists[0]))), F.lit(0)))
    rows = rows.withColumn("_skein_n", F.greatest("_skein_n", F.lit(0)))
    if rows_per_group is not None:
        rows = prefix_sum(rows, "_skein_n", by, "pack_group", name="_skein_off", inclusive=False,
                          bounded_groups=True)
        rows = rows.withColumn("_skein_total", F.sum("_skein_n").over(Window.partitionBy("pack_group")))
    else:
        total = rows.agg(F.sum("_skein_n").alias("t")).collect()[0]["t"] or 0
        rows = prefix_sum(rows, "_skein_n", by, None, name="_skein_off", inclusive=False)
        rows = rows.withColumn("_skein_total", F.lit(total).cast("bigint"))
    rows = rows.filter(F.col("_skein_n") > 0).withColumns(made)
    first = F.floor(F.col("_skein_off") / block_size)
    last = F.floor((F.col("_skein_off") + F.col("_skein_n") - 1) / block_size)
    cut = rows.withColumn("block", F.explode(F.sequence(first, last))).withColumn("block", F.col("block").cast("bigint"))
    keep = (F.col("_skein_total") < block_size) | ((F.col("block") + 1) * block_size <= F.col("_skein_total"))
    begin = F.greatest(F.lit(0), F.col("block") * block_size - F.col("_skein_off"))
    end = F.least(F.col("_skein_n"), (F.col("block") + 1) * block_size - F.col("_skein_off"))
    pieces = cut.filter(keep).select("pack_group", "block", F.struct(
        "_skein_off", *[F.slice(c, (begin + 1).cast("int"), (end - begin).cast("int")).alias(c) for c in lists]).alias("_skein_s"))
    g = pieces.groupBy("pack_group", "block").agg(F.array_sort(F.collect_list("_skein_s")).alias("_skein_s"))

    def joined(name):
        return F.flatten(F.transform("_skein_s", lambda s: s[name])).alias(name)

    return g.select("pack_group", "block", *[joined(c) for c in lists]).withColumn("n_tok", F.size(lists[0]))


def pack(df: DataFrame, vocab: DataFrame, by: Sequence[str], block_size: int, text: str = "text",
         rows_per_group: int | None = 1000, pattern: str = WORD_PATTERN) -> DataFrame:
    """K1/K2 from text: tokenize (unpadded), then pack into blocks.

    Returns (pack_group, block, input_ids, n_tok).
    """
    ids = token_ids(df, by, vocab, text, pattern).select(*by, F.col("ids").alias("input_ids"))
    return pack_lists(ids, ["input_ids"], by, block_size, rows_per_group)


def pack_ids(df: DataFrame, ids: str, by: Sequence[str], block_size: int,
             rows_per_group: int | None = 1000) -> DataFrame:
    """K1/K2 on an existing id array column."""
    return pack_lists(df.select(*by, F.col(ids).alias("input_ids")), ["input_ids"], by, block_size, rows_per_group)
