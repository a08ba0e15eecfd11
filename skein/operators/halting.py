"""Halting rules applied to a logged step table.

Input: steplog (seq_id, <order columns>, q_halt, q_continue), one row per
step of a sequence. The step counter restarts after every halt (W1). Rules
(W2/W3): always halt at ``step >= max_steps``; in training with max > 1 also
halt when ``q_halt > q_continue``. In that case the counter is the position
since the last halt signal, wrapped every ``max_steps`` rows, so it is a
running max of the last signal's rank (associative, bucketed: no per-sequence
single task even for a sequence holding a third of the log).

The exploration term (a random minimum halting step) makes the counter depend
on the previous segment's length; it is handled by ``halt_steps_explore``,
which runs the per-sequence recurrence over bounded buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.operators.ordering import drop_bucket, global_index, scan

MAX_STEPS = 8
EXPLORE_P = 0.1


def rank_steps(steplog: DataFrame, order: Sequence[str], seq: str = "seq_id",
               keep_bucket: bool = False) -> DataFrame:
    """W1 helper: 1-based rank of each logged step within its sequence."""
    ix = global_index(steplog, list(order), seq, name="_skein_r", keep_bucket=keep_bucket)
    return ix.withColumn("rank", F.col("_skein_r") + 1).drop("_skein_r")


def halt_steps(steplog: DataFrame, order: Sequence[str], max_steps: int = MAX_STEPS, training: bool = True,
               seq: str = "seq_id") -> DataFrame:
    """Add rank, step (counter since the last halt) and halted."""
    act = training and max_steps > 1
    r = rank_steps(steplog, order, seq, keep_bucket=act)
    signal = F.col("q_halt") > F.col("q_continue")
    if act:
        r = r.withColumn("_skein_sig", F.when(signal, F.col("rank")))
        r = scan(r, "_skein_sig", ["rank"], seq, name="_skein_last", how="max", inclusive=False)
        p = F.col("rank") - F.coalesce(F.col("_skein_last"), F.lit(0))
    else:
        p = F.col("rank")
    r = r.withColumn("step", (((p - 1) % max_steps) + 1).cast("int"))
    halted = F.col("step") >= max_steps
    if act:
        halted = halted | signal
    return drop_bucket(r.withColumn("halted", halted).drop("_skein_sig", "_skein_last"))


LEAD_CHUNK = 65_536


def halt_targets(steps: DataFrame, max_steps: int = MAX_STEPS, seq: str = "seq_id") -> DataFrame:
    """Bootstrap target for the continue head:
    sigmoid(next_q_halt) at the last step, else sigmoid(max(next_q_halt,
    next_q_continue)); 'next' is the following log row of the same sequence
    (NULL when the log ends). The lead runs within chunks of consecutive ranks;
    the last row of a chunk takes the first row of the next one from a table
    with one row per chunk."""
    chunk = F.floor((F.col("rank") - 1) / LEAD_CHUNK).cast("bigint")
    s = steps.withColumn("_skein_c", chunk)
    w = Window.partitionBy(seq, "_skein_c").orderBy("rank")
    nxt = F.struct(F.col("q_halt").alias("h"), F.col("q_continue").alias("c"))
    s = s.withColumn("_skein_n", F.lead(nxt).over(w))
    edge = steps.filter((F.col("rank") - 1) % LEAD_CHUNK == 0).select(
        F.col(seq).alias("_skein_s"), (chunk - 1).alias("_skein_e"), nxt.alias("_skein_x"))
    j = s.join(edge, F.col(seq).eqNullSafe(F.col("_skein_s")) & (F.col("_skein_c") == F.col("_skein_e")), "left")
    at = F.when(F.col("_skein_n").isNotNull(), F.col("_skein_n")).otherwise(F.col("_skein_x"))
    last = F.col("step") >= max_steps
    j = j.withColumn("next_q_halt", at["h"]).withColumn("next_q_continue", at["c"])
    x = F.when(last, F.col("next_q_halt")).otherwise(F.greatest("next_q_halt", "next_q_continue"))
    return j.withColumn("target_q_continue", F.lit(1.0) / (F.lit(1.0) + F.exp(-x))) \
        .drop("_skein_c", "_skein_n", "_skein_s", "_skein_e", "_skein_x")


def halt_state(steps: DataFrame, seq: str = "seq_id") -> DataFrame:
    """Per sequence: the first halting step (halted=true, steps, logits,
    target); sequences that never halt report their last step, halted=false."""
    cols = [c for c in ("step", "q_halt", "q_continue", "target_q_continue") if c in steps.columns]
    s = F.struct(*cols)
    g = steps.groupBy(seq).agg(F.min_by(s, F.when(F.col("halted"), F.col("rank"))).alias("_h"),
                               F.max_by(s, F.col("rank")).alias("_l"))
    pick = F.coalesce("_h", "_l")
    out = g.select(seq, F.col("_h").isNotNull().alias("halted"), pick["step"].alias("steps"),
                   *[pick[c].alias(c) for c in cols if c != "step"])
    return out


def steps_histogram(state: DataFrame) -> DataFrame:
    """Number of sequences per first-halt step count."""
    return state.filter("halted").groupBy("steps").agg(F.count(F.lit(1)).alias("n_seqs"))


def _min_halt_col(seed: int, seq: str, p: float, max_steps: int):
    """Exploration minimum from md5(seed:a|b:seq:rank): with probability p a
    uniform integer in [2, max_steps], else 0 (the same draw as X5)."""
    from skein.functions.hashing import hash_int, hash_uniform
    u = hash_uniform(seed, F.lit("a"), F.col(seq), F.col("rank"))
    k = hash_int(seed, 2, max_steps, F.lit("b"), F.col(seq), F.col("rank"))
    return F.when(u < F.lit(p), k).otherwise(F.lit(0)).cast("int")


def prefix_maps(sig, min_halt, first, max_steps: int):
    """Prefix compositions of the rows' transition maps, restarted where ``first``.

    Row i maps the counter before it (0..max_steps-1) to the counter after it
    (0 after a halt). Compositions are built by doubling: log2(n) gathers over
    an (n, max_steps) array, no loop over rows."""
    import numpy as np
    n = len(sig)
    state = np.arange(max_steps)[None, :] + 1
    halt = (state >= max_steps) | (np.asarray(sig, bool)[:, None] & (state >= np.asarray(min_halt)[:, None]))
    f = np.where(halt, 0, state).astype(np.int32)
    begin = np.maximum.accumulate(np.where(first, np.arange(n), 0)) if n else np.zeros(0, np.int64)
    d = 1
    while d < n:
        i = np.flatnonzero(np.arange(n) - d >= begin)
        if not len(i):
            break
        f[i] = np.take_along_axis(f[i], f[i - d], axis=1)
        d *= 2
    return f, begin


def halt_steps_explore(steplog: DataFrame, order: Sequence[str], max_steps: int = MAX_STEPS,
                       explore_p: float = EXPLORE_P, seed: int = 42, seq: str = "seq_id",
                       chunk_rows: int = 65536) -> DataFrame:
    """W2 in training with the exploration term: (seq, order..., rank, step, halted).

    The step counter depends on where the previous segment ended, a sequential
    recurrence over a tiny state space (counter 0..max-1). It is scanned like
    any associative operator, as function composition:
      1. per chunk of ``chunk_rows`` consecutive ranks: compose the rows'
         transition maps (a vector of ``max_steps`` ints);
      2. per sequence: pass the chunk maps in order, one row per chunk, to get
         each chunk's start state;
      3. per chunk: read every row's state off the prefix maps.
    All steps run over Arrow batches sorted by (seq, chunk, rank), vectorised
    over a batch's rows; a chunk may span batches. A sequence holding a third
    of the log is many bounded chunks.
    """
    import numpy as np
    import pandas as pd

    r = rank_steps(steplog, order, seq)
    C = "_skein_chunk"
    M = max_steps
    r = r.withColumn("sig", F.coalesce(F.col("q_halt") > F.col("q_continue"), F.lit(False))) \
         .withColumn("min_halt", _min_halt_col(seed, seq, explore_p, max_steps)) \
         .withColumn(C, F.floor((F.col("rank") - 1) / chunk_rows).cast("bigint"))
    key = r.select(seq, C, "rank", *[c for c in order if c != seq], "sig", "min_halt")
    kinds = {f.name: f.dataType.simpleString() for f in key.schema.fields}

    def changes(pdf, cols):
        new = np.ones(len(pdf), bool)
        new[1:] = False
        for c in cols:
            v = pdf[c].to_numpy()
            new[1:] |= v[1:] != v[:-1]
        return new

    def compose(batches):
        cur, fmap = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            first = changes(pdf, [seq, C])
            f, _ = prefix_maps(pdf["sig"].to_numpy(), pdf["min_halt"].to_numpy(), first, M)
            ends = np.append(np.flatnonzero(first)[1:] - 1, len(pdf) - 1)
            keys = list(zip(pdf[seq].to_numpy()[ends], pdf[C].to_numpy()[ends]))
            maps = [f[e] for e in ends]
            if cur is not None:
                if cur == keys[0]:
                    maps[0] = maps[0][fmap]
                else:
                    keys.insert(0, cur)
                    maps.insert(0, fmap)
            cur, fmap = keys[-1], maps[-1]
            if len(keys) > 1:
                yield pd.DataFrame({seq: [k[0] for k in keys[:-1]], C: [k[1] for k in keys[:-1]],
                                    "fmap": [m.tolist() for m in maps[:-1]]})
        if cur is not None:
            yield pd.DataFrame({seq: [cur[0]], C: [cur[1]], "fmap": [fmap.tolist()]})

    sorted_rows = key.repartition(seq, C).sortWithinPartitions(seq, C, "rank")
    maps = sorted_rows.select(seq, C, "sig", "min_halt").mapInPandas(
        compose, f"`{seq}` {kinds[seq]}, {C} long, fmap array<int>")

    def pass_on(batches):
        cur, s = None, 0
        for pdf in batches:
            starts = []
            for k, m in zip(pdf[seq].to_numpy(), pdf["fmap"]):      # one row per chunk
                if k != cur:
                    cur, s = k, 0
                starts.append(s)
                s = int(m[s])
            yield pd.DataFrame({seq: pdf[seq], C: pdf[C], "start": starts})

    starts = maps.repartition(seq).sortWithinPartitions(seq, C).mapInPandas(
        pass_on, f"`{seq}` {kinds[seq]}, {C} long, start int")

    def replay(batches):
        cur, carried = None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            first = changes(pdf, [seq, C])
            sig, least = pdf["sig"].to_numpy(), pdf["min_halt"].to_numpy()
            f, begin = prefix_maps(sig, least, first, M)
            start = pdf["start"].to_numpy()[begin].astype(np.int64)
            head = (pdf[seq].iloc[0], pdf[C].iloc[0])
            if cur == head:
                start[begin == 0] = carried
            i = np.arange(len(pdf))
            before = np.where(i > begin, f[np.maximum(i - 1, 0), start], start)
            step = before + 1
            cur, carried = (pdf[seq].iloc[-1], pdf[C].iloc[-1]), int(f[-1, start[-1]])
            out = pdf[[seq, *[c for c in order if c != seq], "rank"]].copy()
            out["step"] = step.astype(np.int32)
            out["halted"] = (step >= M) | (sig.astype(bool) & (step >= least))
            yield out

    rows = key.join(starts, [seq, C]).repartition(seq, C).sortWithinPartitions(seq, C, "rank")
    shape = ", ".join([f"`{c}` {kinds[c]}" for c in [seq, *[c for c in order if c != seq], "rank"]])
    return rows.mapInPandas(replay, f"{shape}, step int, halted boolean")
