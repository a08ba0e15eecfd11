"""Operator 1: exact top-k inner products with a KD-tree per shard.

Components become integers floor(scale * x). Rows are dealt to shards by
median splits learnt on a bounded sample (a coarse KD-tree); a shard with many
rows, for example of one very common vector, is salted into units of about
``unit_rows``. Each unit builds a KD-tree: median splits of the widest side,
tight bounding boxes, small leaves.

A block of queries walks a tree best first: nodes wait in a heap by their
largest box-to-query bound, sum_i max(q_i lo_i, q_i hi_i); a query takes part
in a node only while the bound reaches its kth score. Round one searches each
query's own unit. Its kth score is propagated: in round two a query visits
only units of shards whose box can still reach it, and starts there with that
kth score. Bounds never understate and ties are kept, so results are exact.

Cases: vectors that are null, hold null or non-finite components, or whose
integers do not fit a long take no part, neither as queries nor as candidates;
shorter vectors count as padded with zeros; a query's candidates are all rows
with another key; repeated rows of a key are candidates of other queries one
by one, and of repeated query rows one (the first by vector) asks; empty
vectors score 0; an empty table gives an empty result. Inner products must fit
a long.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from skein.llm.scratch import save
from skein.llm.vectors import matrix_rows

LEAF, QUERY_BLOCK = 128, 256
MAX_SHARDS = 4096                 # bounds the shard boxes held by the driver and tasks


def integers(df: DataFrame, key: str, vector: str, scale: int) -> DataFrame:
    """(id, dim, v): usable vectors as little-endian 64-bit integers."""
    def run(batches):
        import pyarrow as pa
        for b in batches:
            values, off, ok = matrix_rows(b.column(1))
            scaled = np.floor(scale * values)
            big = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < 2.0 ** 63))])
            ok = ok & (big[off[1:]] == big[off[:-1]])
            whole = np.where(np.abs(scaled) < 2.0 ** 63, scaled, 0).astype("<i8")
            at = np.flatnonzero(ok)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(at)), pa.array((off[1:] - off[:-1])[at].astype(np.int32)),
                 pa.array([whole[off[i]:off[i + 1]].tobytes() for i in at], pa.binary())], names=["id", "dim", "v"])

    return df.select(F.col(key).cast("bigint").alias("id"), F.col(vector).alias("_v")).filter("id is not null") \
        .mapInArrow(run, "id long, dim int, v binary")


def unpack(col, dim: int) -> np.ndarray:
    """Matrix of an Arrow binary column of integers, padded with zeros to ``dim``."""
    parts = col.to_pylist()
    if all(len(p) == 8 * dim for p in parts):
        return np.frombuffer(b"".join(parts), "<i8").reshape(len(parts), dim)
    out = np.zeros((len(parts), dim), np.int64)
    for i, p in enumerate(parts):
        x = np.frombuffer(p, "<i8")
        out[i, :len(x)] = x
    return out


def coarse_splits(sample: np.ndarray, shards: int) -> list[tuple[int, int]]:
    """Median splits of the widest side, breadth first, as a heap of (dimension, threshold); -1: none."""
    out: list[tuple[int, int]] = []
    level = [sample]
    while len(level) < shards:
        nxt = []
        for x in level:
            side = x.max(axis=0) - x.min(axis=0) if len(x) > 1 else np.zeros(0)
            if len(side) == 0 or side.max() == 0:
                out.append((-1, 0))
                nxt += [x, x[:0]]
                continue
            d = int(side.argmax())
            t = int(np.sort(x[:, d])[(len(x) - 1) // 2])
            if t == x[:, d].max():
                t -= 1
            out.append((d, t))
            nxt += [x[x[:, d] <= t], x[x[:, d] > t]]
        level = nxt
    return out


def shard_of(x: np.ndarray, splits: list[tuple[int, int]]) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    dims = np.array([d for d, _ in splits] or [-1])
    cut = np.array([t for _, t in splits] or [0])
    while (live := node < len(splits)).any():
        i = np.flatnonzero(live)
        d = dims[node[i]]
        right = (d >= 0) & (x[i, np.maximum(d, 0)] > cut[node[i]])
        node[i] = 2 * node[i] + 1 + right
    return node - len(splits)


class Tree:
    """KD-tree of integer vectors with tight boxes; ``exact`` tells whether doubles hold all products."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, query_peak: float) -> None:
        peak = float(np.abs(x.astype(float)).max(initial=0))
        self.exact = peak * max(query_peak, 1) * max(x.shape[1], 1) < 2.0 ** 53
        self.ids, self.lo, self.hi, self.kids, self.rows = ids, [], [], [], []
        self.x = x.astype(np.float64) if self.exact else x
        order = np.arange(len(ids))
        self._build(x, order)

    def _build(self, x: np.ndarray, order: np.ndarray) -> int:
        me = len(self.kids)
        lo, hi = x[order].min(axis=0), x[order].max(axis=0)
        self.lo.append(lo.astype(float))
        self.hi.append(hi.astype(float))
        self.kids.append(None)
        self.rows.append(None)
        side = hi.astype(float) - lo
        if len(order) <= LEAF or len(side) == 0 or side.max() == 0:
            self.rows[me] = order
            return me
        d = int(side.argmax())
        rank = order[np.argsort(x[order, d], kind="stable")]
        mid = len(rank) // 2
        self.kids[me] = (self._build(x, rank[:mid]), self._build(x, rank[mid:]))
        return me

    def search(self, qid: np.ndarray, q: np.ndarray, kth: np.ndarray, k: int):
        """(query index, id, score) of the k best at least as good as kth, per query."""
        kth = kth.copy()
        plus, minus = np.maximum(q, 0).astype(float), np.minimum(q, 0).astype(float)
        own = q.astype(np.float64) if self.exact else q

        def bound(node):
            b = plus @ self.hi[node] + minus @ self.lo[node]
            return b if self.exact else b + np.abs(b) * 1e-9 + 1

        at, ids, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        b0 = bound(0)
        heap = [(-b0.max(initial=-np.inf), 0, b0)]
        while heap:
            _, node, b = heapq.heappop(heap)
            act = np.flatnonzero(b >= kth)
            if not len(act):
                continue
            if self.kids[node] is not None:
                for kid in self.kids[node]:
                    kb = bound(kid)
                    heapq.heappush(heap, (-kb[act].max(), kid, kb))
                continue
            rows = self.rows[node]
            s = own[act] @ self.x[rows].T
            hit = (s >= kth[act][:, None]) & (self.ids[rows][None, :] != qid[act][:, None])
            i, j = np.nonzero(hit)
            if not len(i):
                continue
            at = np.concatenate([at, act[i]])
            ids = np.concatenate([ids, self.ids[rows][j]])
            score = np.concatenate([score, s[i, j].astype(np.int64)])
            order = np.lexsort((ids, -score, at))
            at, ids, score = at[order], ids[order], score[order]
            place = np.arange(len(at)) - np.searchsorted(at, at)
            keep = place < k
            at, ids, score = at[keep], ids[keep], score[keep]
            full = place[keep] == k - 1
            kth[at[full]] = score[full]
        return at, ids, score


def _search_units(dim: int, k: int, query_peak: float):
    """Rows sorted by (unit, role): a unit's vectors (role 0), then its queries (role 1)."""
    def run(batches):
        import pyarrow as pa
        unit, ids, xs, tree = None, [], [], None
        wait: list = []

        def ask():
            nonlocal wait
            qid = np.concatenate([w[0] for w in wait])
            q = np.concatenate([w[1] for w in wait])
            kth = np.concatenate([w[2] for w in wait])
            wait = []
            if tree is None:
                return
            for lo in range(0, len(qid), QUERY_BLOCK):
                s = slice(lo, lo + QUERY_BLOCK)
                at, vid, score = tree.search(qid[s], q[s], kth[s], k)
                yield pa.RecordBatch.from_arrays([pa.array(qid[s][at]), pa.array(vid), pa.array(score)],
                                                 names=["query_id", "vec_id", "score"])

        for b in batches:
            units = b.column(0).to_numpy()
            role = b.column(1).to_numpy()
            cut = np.flatnonzero(np.append(True, (units[1:] != units[:-1]) | (role[1:] != role[:-1])))
            for lo, hi in zip(cut, np.append(cut[1:], len(units)), strict=True):
                if units[lo] != unit:
                    if wait:
                        yield from ask()
                    unit, ids, xs, tree = units[lo], [], [], None
                part = b.slice(lo, hi - lo)
                x = unpack(part.column(3), dim)
                if role[lo] == 0:
                    ids.append(part.column(2).to_numpy())
                    xs.append(x)
                else:
                    if tree is None and ids:
                        tree = Tree(np.concatenate(ids), np.concatenate(xs), query_peak)
                        ids, xs = [], []
                    wait.append((part.column(2).to_numpy(), x, part.column(4).to_numpy(zero_copy_only=False)))
                    if sum(len(w[0]) for w in wait) >= QUERY_BLOCK:
                        yield from ask()
        if wait:
            yield from ask()
    return run


def top_k(df: DataFrame, queries: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding",
          scale: int = 64, unit_rows: int = 4096, sample_rows: int = 20_000) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest scores of each query, ties to the smaller key.

    ``queries``: condition over the key column that names the query rows."""
    spark = df.sparkSession
    empty = "query_id long, rank int, vec_id long, score long"
    vec = save(integers(df, key, vector, scale), "vectors")
    head = vec.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
    n, dim = head["n"], head["dim"] or 0
    if not n:
        return spark.createDataFrame([], empty)
    u = F.xxhash64("id", F.lit("kd")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    sample = vec.filter(u < min(1.0, sample_rows / n)).select("v").toArrow()           # bounded by sample_rows
    pts = unpack(sample.column(0).combine_chunks(), dim) if sample.num_rows else np.zeros((0, dim), np.int64)
    shards = 1
    while shards < MAX_SHARDS and shards * unit_rows < n:
        shards *= 2
    splits = coarse_splits(pts, shards)

    def deal(batches):
        import pyarrow as pa
        for b in batches:
            x = unpack(b.column(1), dim)
            peak = np.abs(x.astype(float)).max(axis=1, initial=0)
            yield pa.RecordBatch.from_arrays([pa.array(shard_of(x, splits)), b.column(0), b.column(1), pa.array(peak)],
                                             names=["shard", "id", "v", "peak"])

    dealt = save(vec.select("id", "v").mapInArrow(deal, "shard long, id long, v binary, peak double"), "shards")

    def boxes(batches):
        import pyarrow as pa
        lo: dict[int, np.ndarray] = {}
        hi: dict[int, np.ndarray] = {}
        count: dict[int, int] = {}
        for b in batches:
            x, s = unpack(b.column(1), dim), b.column(0).to_numpy()
            for k_ in np.unique(s).tolist():
                m = x[s == k_]
                lo[k_] = np.minimum(lo.get(k_, m[0]), m.min(axis=0))
                hi[k_] = np.maximum(hi.get(k_, m[0]), m.max(axis=0))
                count[k_] = count.get(k_, 0) + len(m)
        yield pa.RecordBatch.from_pydict({
            "shard": pa.array(list(lo), pa.int64()), "n": pa.array([count[s] for s in lo], pa.int64()),
            "lo": pa.array([v.tolist() for v in lo.values()], pa.list_(pa.int64())),
            "hi": pa.array([v.tolist() for v in hi.values()], pa.list_(pa.int64()))})

    per = dealt.select("shard", "v").mapInArrow(boxes, "shard long, n long, lo array<long>, hi array<long>")
    agg = per.groupBy("shard").agg(F.sum("n").alias("n"), *[F.min(F.col("lo")[i]).alias(f"l{i}") for i in range(dim)],
                                   *[F.max(F.col("hi")[i]).alias(f"h{i}") for i in range(dim)]).collect()
    box = {r["shard"]: (r["n"], np.array([r[f"l{i}"] for i in range(dim)], float),
                        np.array([r[f"h{i}"] for i in range(dim)], float)) for r in agg}   # at most MAX_SHARDS rows
    salts = {s: -(-b[0] // unit_rows) for s, b in box.items()}
    peak = dealt.agg(F.max("peak")).first()[0]
    spread = F.create_map(*[F.lit(x) for s, m in salts.items() for x in (int(s), int(m))])
    unit = F.col("shard") * F.lit(1 << 32) + F.pmod(F.xxhash64("id"), F.element_at(spread, F.col("shard")))
    data = dealt.select(unit.alias("unit"), F.lit(0).alias("role"), "id", "v", F.lit(float("-inf")).alias("kth"), "shard")
    ask = dealt.withColumnRenamed("id", key).filter(queries).withColumnRenamed(key, "id")
    ask = ask.groupBy("id").agg(F.min(F.struct("v", "shard")).alias("q")).select("id", "q.v", "q.shard")

    def search(asked: DataFrame) -> DataFrame:
        both = data.drop("shard").unionByName(asked.select("unit", F.lit(1).alias("role"), "id", "v", "kth"))
        return both.repartition("unit").sortWithinPartitions("unit", "role").mapInArrow(
            _search_units(dim, k, peak or 0.0), "query_id long, vec_id long, score long")

    home = ask.select(unit.alias("unit"), "id", "v", F.lit(float("-inf")).alias("kth"), "shard")
    first = save(search(home), "first")
    kth = first.groupBy("query_id").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("m")) \
        .filter(F.col("c") >= k).select(F.col("query_id").alias("id"), F.col("m").cast("double").alias("kth"))
    asked = home.drop("kth").join(kth, "id", "left").withColumn("kth", F.coalesce("kth", F.lit(float("-inf"))))
    names = sorted(box)
    lows = np.array([box[s][1] for s in names])
    highs = np.array([box[s][2] for s in names])

    def route(batches):
        import pyarrow as pa
        for b in batches:
            home_unit, qid, kth_ = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
            x = unpack(b.column(2), dim).astype(float)
            reach = np.maximum(x, 0) @ highs.T + np.minimum(x, 0) @ lows.T
            reach = reach + np.abs(reach) * 1e-9 + 1e-6
            for j, s in enumerate(names):
                for salt in range(salts[s]):
                    u_ = (s << 32) + salt
                    go = np.flatnonzero((reach[:, j] >= kth_) & (home_unit != u_))
                    if len(go):
                        t = pa.array(go)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(go), u_)), b.column(1).take(t),
                                                          b.column(2).take(t), pa.array(kth_[go])],
                                                         names=["unit", "id", "v", "kth"])

    visits = asked.select("unit", "id", "v", "kth").mapInArrow(route, "unit long, id long, v binary, kth double")
    second = search(visits)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return first.unionByName(second).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
