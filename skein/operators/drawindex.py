"""Rank and select over the draws of a weighted mix.

Position k of a mix draws a source from md5(seed:mix:k) alone, so the draws need
not be stored: the index keeps how often each source was drawn in every block
of ``block`` positions, and before it. From that,

* ``rank``: the draws of each source before any position (the cursors of a
  resumed job) take the counts before one block and the draws of that block;
* ``select``: the position of a source's n-th draw is found in the one block
  that holds it;
* ``plan``: any range of positions is drawn block by block. Blocks are dealt to
  tasks as single rows and drawn there, so no draw is shuffled.

Where the mix ends is a ``select`` for each source. Covering a large source of
tiny weight costs more counts, never a stored or repeated plan.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions.hashing import hash_uniform
from skein.operators.mixing import K_SLACK, SEED, salted_join, source_choice
from skein.operators.ordering import global_index
from skein.session import shuffle_partitions, stored

BLOCK = 1 << 16


@dataclass
class DrawIndex:
    sizes: dict[str, int]                     # rows of each source, those of weight 0 left out
    weights: list[float]
    seed: int
    block: int
    blocks: int                               # blocks counted
    counts: DataFrame                         # block, source, n, before: a row where n > 0

    def _draw(self, blocks: DataFrame) -> DataFrame:
        """(block, ..., k, source) of every position of the blocks, which stay where they are."""
        lo = F.col("block") * self.block
        return blocks.withColumn("k", F.explode(F.sequence(lo, lo + (self.block - 1)))) \
            .withColumn("source", source_choice(hash_uniform(self.seed, F.lit("mix"), F.col("k")), list(self.sizes), self.weights))

    def rank(self, k: int) -> dict[str, int]:
        """Draws of each source before position k."""
        at = k // self.block
        if at >= self.blocks:
            raise ValueError(f"position {k} lies beyond the counted blocks")
        spark = self.counts.sparkSession
        whole = self.counts.filter(F.col("block") < at).groupBy("source").agg(F.sum("n").alias("n"))
        part = self._draw(spark.range(at, at + 1).withColumnRenamed("id", "block")).filter(F.col("k") < k) \
            .groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        got = {r["source"]: int(r["n"]) for r in whole.unionByName(part).groupBy("source").agg(F.sum("n").alias("n")).collect()}
        return {s: got.get(s, 0) for s in self.sizes}

    def select(self, nth: dict[str, int]) -> dict[str, int | None]:
        """Position of draw number nth[s] (from 0) of each source s; None beyond the counted blocks."""
        want = F.create_map(*[x for s, c in nth.items() for x in (F.lit(s), F.lit(int(c)).cast("bigint"))])
        hit = self.counts.withColumn("want", want[F.col("source")]) \
            .filter((F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("n")))
        held = {r["source"]: r for r in hit.collect()}                   # one row a source
        if not held:
            return dict.fromkeys(nth)
        # a block that several sources end in is drawn once
        some = sorted({r["block"] for r in held.values()})
        drawn = self._draw(self.counts.sparkSession.createDataFrame([(b,) for b in some], "block long")) \
            .withColumn("c", F.row_number().over(Window.partitionBy("block", "source").orderBy("k")) - 1)
        pick = F.lit(False)
        for s, r in held.items():
            pick = pick | ((F.col("source") == s) & (F.col("block") == r["block"]) & (F.col("c") == r["want"] - r["before"]))
        got = {r["source"]: r["k"] for r in drawn.filter(pick).collect()}
        return {s: got.get(s) for s in nth}

    def plan(self, lo: int, hi: int) -> DataFrame:
        """(k, source, c, row, epoch) of the positions [lo, hi)."""
        spark = self.counts.sparkSession
        first, last = lo // self.block, max(-(-hi // self.block), lo // self.block)
        if last > self.blocks:
            raise ValueError(f"position {hi} lies beyond the counted blocks")
        before = self.counts.filter((F.col("block") >= first) & (F.col("block") < last)).groupBy("block") \
            .agg(F.map_from_entries(F.collect_list(F.struct("source", "before"))).alias("before"))   # a few sources a block
        dealt = before.repartition(shuffle_partitions(spark), "block")
        drawn = self._draw(dealt).withColumn(
            "c", F.row_number().over(Window.partitionBy("block", "source").orderBy("k")) - 1 + F.col("before")[F.col("source")])
        n = F.create_map(*[x for s, v in self.sizes.items() for x in (F.lit(s), F.lit(int(v)).cast("bigint"))])[F.col("source")]
        return drawn.filter((F.col("k") >= lo) & (F.col("k") < hi)).select(
            "k", "source", F.col("c").cast("bigint").alias("c"), (F.col("c") % n).cast("bigint").alias("row"),
            F.floor(F.col("c") / n).cast("bigint").alias("epoch"))


def draw_index(spark: SparkSession, sizes: dict[str, int], weights: dict[str, float], seed: int = SEED,
               stop: str = "all_exhausted", block: int = BLOCK) -> tuple[DrawIndex, int]:
    """The index of the draws until the mix ends, and its length K. Blocks are counted until every source is
    covered (``first_exhausted``: until one is); each block once."""
    if stop not in ("all_exhausted", "first_exhausted"):
        raise ValueError(f"unknown stopping strategy {stop!r}")
    live = {s: int(n) for s, n in sizes.items() if float(weights.get(s, 1.0)) > 0}
    w = [float(weights.get(s, 1.0)) for s in live]
    if not live or sum(w) <= 0:
        raise ValueError("weights must sum to a positive number")
    empty = [s for s, n in live.items() if n <= 0]
    if empty:
        raise ValueError(f"sources without rows cannot be interleaved: {empty}")
    need = [n * sum(w) / x for n, x in zip(live.values(), w)]
    goal = max(need) if stop == "all_exhausted" else min(need)
    done, parts = 0, None
    ends = {s: n - 1 for s, n in live.items()}
    until = math.ceil((goal * K_SLACK + 64) / block)
    while True:
        index = DrawIndex(live, w, seed, block, until, None)
        new = index._draw(spark.range(done, until).withColumnRenamed("id", "block")) \
            .groupBy("block", "source").agg(F.count(F.lit(1)).alias("n"))
        new = stored(new, "draw-counts")
        parts = new if parts is None else parts.unionByName(new)
        sums = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        index.counts = stored(parts.withColumn("before", F.coalesce(F.sum("n").over(sums), F.lit(0)).cast("bigint")), "draw-index")
        at = index.select(ends)
        known = [k for k in at.values() if k is not None]
        if stop == "all_exhausted" and len(known) == len(live):
            return index, max(known) + 1
        if stop == "first_exhausted" and known:
            return index, min(known) + 1
        done, until = until, until + max(1, until // 4)


def interleave_indexed(spark: SparkSession, data: DataFrame, weights: dict[str, float], by: Sequence[str], seed: int = SEED,
                       stop: str = "all_exhausted", start: int = 0, end: int | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``interleave`` at positions [start, end) of the mix, with (k, epoch). Only the
    blocks of that range are drawn."""
    got = {r["source"]: int(r["n"]) for r in data.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {s: got[s] for s in weights if s in got and weights[s] > 0}
    index, total = draw_index(spark, sizes, weights, seed, stop, block)
    hi = total if end is None else min(end, total)
    plan = index.plan(min(start, hi), hi)
    last = index.rank(hi - 1) if hi else dict.fromkeys(sizes, 0)
    first = index.rank(min(start, hi - 1)) if hi else last
    salts = {s: max(1, math.ceil((last[s] + 1 - first[s]) / n) + 1) for s, n in sizes.items()}     # epochs that the range touches
    pos = global_index(data.filter(F.col("source").isin(list(sizes))), by, "source", name="row")
    return salted_join(plan, pos, ["source", "row"], salts).drop("c", "row")
