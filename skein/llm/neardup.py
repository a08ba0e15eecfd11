"""Operator 7: embedding near-duplicates by collision-counting projections.

Equal vectors of a label become one class with a multiplicity. Each class is
projected on ``PROJECTIONS`` random directions. Two unit vectors with cosine c
differ by sqrt(2 - 2c), so their projections differ by a normal deviate of
sqrt((2 - 2c) / dim); around each query a window of ``WINDOW`` such deviations
holds a true neighbour with probability p = erf(WINDOW / sqrt(2)). The
collision count of a neighbour is binomial(PROJECTIONS, p) at worst, and the
required count is the greatest that keeps ``recall`` of them. Pairs passing
the count are verified by their cosine in double precision.

Distribution: rows of a label are sorted by their first projection into slabs
``REACH`` deviations wide, so neighbours lie in the same or the next slab;
slabs are cut into blocks of about ``BLOCK`` rows and every task gets one pair
of blocks, so a hot label or slab is many tasks. In a task the projections of
a block are sorted once each and every query counts its windows. Tasks return
link counts and a spanning forest, never all pairs.

Cases: vectors that are null, zero or hold null or non-finite components, and
rows without label, link with nothing; vectors of different length never link;
repeated rows are vectors of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.scratch import components, save
from skein.llm.vectors import matrix_rows

PROJECTIONS = 32
WINDOW = 1.5
REACH = 4.0
BLOCK = 1024


def needed_count(recall: float, m: int = PROJECTIONS, window: float = WINDOW) -> int:
    """Greatest count c with P(binomial(m, p) >= c) >= recall."""
    p = math.erf(window / math.sqrt(2))
    tail = 0.0
    for c in range(m, -1, -1):
        tail += math.comb(m, c) * p ** c * (1 - p) ** (m - c)
        if tail >= recall:
            return c
    return 0


def directions(dim: int, seed: int = 11) -> np.ndarray:
    """Normal directions scaled so that a unit vector's projection has variance 1 / dim."""
    return np.random.default_rng(seed + dim).normal(0, 1 / math.sqrt(max(dim, 1)), (dim, PROJECTIONS))


def _collisions(a: np.ndarray, b: np.ndarray, width: float) -> np.ndarray:
    """How many projections put each row of b within ``width`` of each row of a."""
    count = np.zeros(len(a) * len(b), np.int64)
    for t in range(a.shape[1]):
        order = np.argsort(b[:, t], kind="stable")
        line = b[order, t]
        lo = np.searchsorted(line, a[:, t] - width)
        size = np.searchsorted(line, a[:, t] + width, "right") - lo
        row = np.repeat(np.arange(len(a)), size)
        within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        count[row * len(b) + order[np.repeat(lo, size) + within]] += 1     # a pair once per projection
    return count.reshape(len(a), len(b))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Smallest node reachable from each of n nodes over the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def link(df: DataFrame, threshold: float = 0.98, recall: float = 0.999, key: str = "vec_id",
         vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept), one row per input row."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")
    least = needed_count(recall)
    gap = math.sqrt(2 - 2 * threshold)

    def prepare(batches):
        import pyarrow as pa
        for b in batches:
            values, off, ok = matrix_rows(b.column(2))
            rows = []
            for i in range(b.num_rows):
                x = values[off[i]:off[i + 1]]
                rows.append(x.astype("<f8").tobytes() if ok[i] and x.any() else None)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())],
                                             names=["id", "label", "v"])

    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(label).cast("string").alias("label"),
                     F.col(vector).alias("_v")).mapInArrow(prepare, "id long, label string, v binary") \
        .withColumn("v", F.when(F.col("label").isNotNull() & F.col("id").isNotNull(), F.col("v"))) \
        .withColumn("same", F.sha2(F.concat(F.col("label").cast("binary"), F.lit("/").cast("binary"), "v"), 256))
    rows = save(rows, "vectors")
    classes = rows.filter("v is not null").groupBy("same").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("mult"), F.min(F.struct("label", "v")).alias("x")) \
        .select("id", "mult", "x.label", "x.v")

    def project(batches):
        import pyarrow as pa
        turn: dict[int, np.ndarray] = {}
        for b in batches:
            n = b.num_rows
            slab, dims, unit, proj = np.zeros(n, np.int64), np.zeros(n, np.int32), [], []
            for i, v in enumerate(b.column(3).to_pylist()):
                x = np.frombuffer(v, "<f8")
                x = x / np.abs(x).max()                       # no overflow or underflow of the norm
                x = x / np.linalg.norm(x)
                d = len(x)
                if d not in turn:
                    turn[d] = directions(d)
                p = x @ turn[d]
                slab[i], dims[i] = math.floor(p[0] / (REACH * gap / math.sqrt(d))), d
                unit.append(x.astype("<f8").tobytes())
                proj.append(p.astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), pa.array(dims), pa.array(slab), pa.array(unit, pa.binary()),
                 pa.array(proj, pa.binary())], names=["id", "mult", "label", "dim", "slab", "u", "p"])

    lines = save(classes.select("id", "mult", "label", "v").mapInArrow(
        project, "id long, mult long, label string, dim int, slab long, u binary, p binary"), "projections")
    # Blocks per slab from measured counts; a row goes to one block and meets its own and the next slab's blocks.
    size = lines.groupBy("label", "dim", "slab").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    nxt = size.select("label", "dim", (F.col("slab") - 1).alias("slab"), F.col("blocks").alias("next_blocks"))
    prev = size.select("label", "dim", (F.col("slab") + 1).alias("slab"), F.col("blocks").alias("prev_blocks"))
    size = size.join(nxt, ["label", "dim", "slab"], "left").join(prev, ["label", "dim", "slab"], "left") \
        .na.fill(0, ["next_blocks", "prev_blocks"])
    placed = lines.join(size, ["label", "dim", "slab"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    # Task = (slab, own block, other slab 0/1 ahead, other block); side 0 asks, side 1 is searched.
    task = lambda slab, a, ahead, b, side: F.struct(
        slab.alias("slab"), a.alias("a"), F.lit(ahead).alias("ahead"), b.alias("b"), F.lit(side).alias("side"))
    upto = lambda hi: F.when(hi >= 0, F.sequence(F.lit(0), hi)).otherwise(F.array().cast("array<int>"))
    me, slab = F.col("block"), F.col("slab")
    tasks = F.concat(
        F.transform(F.sequence(me, F.col("blocks") - 1), lambda b: task(slab, me, 0, b, 0)),
        F.transform(upto(me - 1), lambda a: task(slab, a, 0, me, 1)),
        F.transform(upto(F.col("next_blocks") - 1), lambda b: task(slab, me, 1, b, 0)),
        F.transform(upto(F.col("prev_blocks") - 1), lambda a: task(slab - 1, a, 1, me, 1)))
    dealt = placed.select("label", "dim", "id", "mult", "u", "p", F.explode(tasks).alias("t")) \
        .select("label", "dim", "t.slab", "t.a", "t.ahead", "t.b", "t.side", "id", "mult", "u", "p")
    group = ["label", "dim", "slab", "a", "ahead", "b"]

    def compare(table):
        import pandas as pd
        d = int(table["dim"].iloc[0])
        inside = table["ahead"].iloc[0] == 0 and table["a"].iloc[0] == table["b"].iloc[0]
        ask = table[table["side"] == 0]
        other = ask if inside else table[table["side"] == 1]
        blank = pd.DataFrame({"id": pd.Series(dtype="int64"), "other": pd.Series(dtype="int64"),
                              "links": pd.Series(dtype="int64")})
        if not len(ask) or not len(other):
            return blank
        load = lambda s, kind, w: np.frombuffer(b"".join(s), kind).reshape(len(s), w)
        width = WINDOW * gap / math.sqrt(d)
        hits = _collisions(load(ask["p"], "<f4", PROJECTIONS).astype(float),
                           load(other["p"], "<f4", PROJECTIONS).astype(float), width + 1e-6) >= least
        if inside:
            hits = np.triu(hits, 1)
        i, j = np.nonzero(hits)
        ua, ub = load(ask["u"], "<f8", d), load(other["u"], "<f8", d)
        cos = np.concatenate([np.zeros(0), *[np.einsum("ij,ij->i", ua[i[s:s + 65536]], ub[j[s:s + 65536]])
                                             for s in range(0, len(i), 65536)]])
        i, j = i[cos >= threshold], j[cos >= threshold]
        if not len(i):
            return blank
        ia, ib = ask["id"].to_numpy(), other["id"].to_numpy()
        ma, mb = ask["mult"].to_numpy(), other["mult"].to_numpy()
        nodes, pos = np.unique(np.concatenate([ia[i], ib[j]]), return_inverse=True)
        links = np.bincount(pos, np.concatenate([mb[j], ma[i]]), len(nodes)).astype(np.int64)
        root = forest(pos[:len(i)], pos[len(i):], len(nodes))
        return pd.DataFrame({"id": nodes, "other": nodes[root], "links": links})

    found = save(dealt.groupBy(*group).applyInPandas(compare, "id long, other long, links long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.filter("id <> other"), "id", "other")
    info = classes.select("id", "mult").join(counts, "id", "left") \
        .join(roots.select(F.col("node").alias("id"), "root"), "id", "left") \
        .select(F.col("id").alias("rep"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"),
                F.coalesce("root", "id").alias("root"))
    reps = rows.filter("v is not null").groupBy("same").agg(F.min("id").alias("rep")).join(info, "rep").drop("rep")
    return rows.select("id", "same").join(reps, "same", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("root", "id").alias("component_id")) \
        .withColumn("kept", F.coalesce(F.col("component_id") == F.col(key), F.lit(True)))
