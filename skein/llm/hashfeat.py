"""Bounded labelled samples and sparse text features, shared by the text classifiers.

Features of a text: selected terms (64-bit hashes, value log(1 + count)) and a
few shape measures. Terms are lower-cased words and the first 4 and 5 bytes of
longer words, which catch inflected forms. A labelled sample is drawn by a hash
of the key, about ``per_class`` whole documents a class; the small sampled key
list is broadcast, so texts are never shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.bytesops import SpanHash, lower_table, row_chunks, rows_of, seed_table, spans, text_arrays
from skein.llm.scratch import bound_batches

N_SHAPE = 7
PREFIXES = (4, 5)


def word_bytes() -> np.ndarray:
    m = np.zeros(256, bool)
    m[48:58] = m[65:91] = m[97:123] = True
    m[128:] = True
    return m


def words(data: np.ndarray, off: np.ndarray, hasher: SpanHash):
    """(row, length) of every word, and (row, hash) of every term."""
    s, e = spans(word_bytes()[data], off)
    row, length = rows_of(off, s), e - s
    c = hasher.sums(data, seed_table(lower_table()))
    rows, hashes = [row], [hasher.of(c, s, e)]
    for n in PREFIXES:
        long = length > n
        rows.append(row[long])
        hashes.append(hasher.of(c, s[long], s[long] + n) ^ np.uint64(n))     # apart from whole words
    return row, length, np.concatenate(rows), np.concatenate(hashes)


def shape(data: np.ndarray, off: np.ndarray, row: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Shape measures per row: log words, mean word length, shares of capitals,
    symbols, digits, spaces and of words longer than 12 bytes."""
    n = len(off) - 1
    size = np.maximum(np.diff(off), 1)

    def part(mask):
        c = np.concatenate([[0], np.cumsum(mask)])
        return (c[off[1:]] - c[off[:-1]]) / size

    count = np.bincount(row, minlength=n)
    some = np.maximum(count, 1)
    symbol = (data > 32) & ~word_bytes()[data] & ~np.isin(data, np.frombuffer(b".,", np.uint8))
    return np.stack([np.log1p(count) / 5, np.bincount(row, length, n) / some / 8,
                     3 * part((data >= 65) & (data <= 90)), 5 * part(symbol), 5 * part((data >= 48) & (data <= 57)),
                     3 * part(data == 32), 2 * np.bincount(row, length > 12, n) / some], axis=1)


def sample_labelled(docs: DataFrame, labels: DataFrame, target: Column, per_class: int, key: str = "doc_id",
                    text: str = "text") -> tuple[DataFrame, dict[int, int]]:
    """(sampled rows (k, t, y), rows per class). ``target`` is an int class over
    ``labels``; null classes, keys and texts are left out."""
    bound_batches(docs.sparkSession)
    lab = labels.select(F.col(key).alias("k"), target.cast("int").alias("y")).filter("k is not null and y is not null") \
        .groupBy("k").agg(F.max("y").alias("y"))
    sizes = {r["y"]: r["n"] for r in lab.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    rate = F.lit(0.0)
    for y, n in sizes.items():
        rate = F.when(F.col("y") == y, F.lit(min(1.0, per_class / n))).otherwise(rate)
    u = F.xxhash64(F.col("k"), F.lit("sample")).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    few = F.broadcast(lab.filter(u < rate))       # about per_class rows a class
    rows = docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).filter("t is not null")
    return rows.join(few, "k").select("k", "t", "y"), sizes


def select_words(sample: DataFrame, n_classes: int, limit: int, min_docs: int = 5) -> np.ndarray:
    """Hashes (sorted) of the ``limit`` terms that tell the classes apart best:
    by the chi-square of document counts against the class sizes."""

    def count(batches):
        import pyarrow as pa
        hasher = SpanHash()
        for b in batches:
            data, off = text_arrays(b.column(0))
            y = b.column(1).to_numpy(zero_copy_only=False)
            hs, ys = [], []
            for lo, hi in row_chunks(off):
                _, _, row, h = words(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hasher)
                order = np.lexsort((h, row))
                row, h = row[order], h[order]
                keep = np.ones(len(h), bool)
                keep[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                hs.append(h[keep])
                ys.append(y[lo:hi][row[keep]])
            h, yy = np.concatenate([np.zeros(0, np.uint64), *hs]), np.concatenate([np.zeros(0, np.int64), *ys])
            u, inv = np.unique(h, return_inverse=True)
            table = np.bincount(inv * n_classes + yy.astype(np.int64), minlength=len(u) * n_classes).reshape(-1, n_classes)
            yield pa.RecordBatch.from_pydict({"h": pa.array(u.astype(np.int64)),
                                              **{f"c{j}": pa.array(table[:, j].astype(np.int64)) for j in range(n_classes)}})

    schema = "h long, " + ", ".join(f"c{j} long" for j in range(n_classes))
    per = sample.select("t", "y").mapInArrow(count, schema).groupBy("h").agg(
        *[F.sum(f"c{j}").alias(f"c{j}") for j in range(n_classes)])
    n = sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()
    size = np.zeros(n_classes)
    for r in n:
        size[r["y"]] = r["n"]
    all_docs = max(size.sum(), 1.0)
    df = sum(F.col(f"c{j}") for j in range(n_classes))
    chi = F.lit(0.0)
    for j in range(n_classes):
        if size[j]:
            want = df * F.lit(float(size[j] / all_docs))
            chi = chi + (F.col(f"c{j}") - want) * (F.col(f"c{j}") - want) / want / (1 - df / F.lit(float(all_docs + 1)))
    top = per.filter(df >= min_docs).select("h", chi.alias("chi")).orderBy(F.desc("chi"), "h").limit(limit).collect()
    return np.sort(np.array([r["h"] for r in top], np.int64).astype(np.uint64))


class Lookup:
    """Position of a hash in a small sorted array, -1 if absent; a bitmap drops most misses."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = keys
        self.bits = np.zeros(1 << 18, bool)
        self.bits[keys >> np.uint64(46)] = True

    def __call__(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index into h, feature) of the hashes present."""
        at = np.flatnonzero(self.bits[h >> np.uint64(46)])
        if not len(at) or not len(self.keys):
            return at[:0], at[:0]
        pos = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        hit = self.keys[pos] == h[at]
        return at[hit], pos[hit]


def featurize(col, look: Lookup, hasher: SpanHash):
    """Yield (lo, hi, row, feature, value, shape, words per row) for row ranges of an Arrow column."""
    data, off = text_arrays(col)
    n_feat = max(len(look.keys), 1)
    for lo, hi in row_chunks(off):
        part, o = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        row, length, trow, h = words(part, o, hasher)
        at, feat = look(h)
        pair, n = np.unique(trow[at] * n_feat + feat, return_counts=True)
        yield lo, hi, pair // n_feat, pair % n_feat, np.log1p(n), shape(part, o, row, length), \
            np.bincount(row, minlength=hi - lo)


def collect_matrix(sample: DataFrame, keys: np.ndarray) -> dict[str, np.ndarray]:
    """The sample as one sparse matrix on the driver: bounded by the sample and the selected words."""
    def run(batches):
        import pyarrow as pa
        hasher, look = SpanHash(), Lookup(keys)
        for b in batches:
            k = b.column(0).cast("string").to_pylist()
            y = b.column(2).to_numpy(zero_copy_only=False).astype(np.int32)
            for lo, hi, row, feat, val, shp, _ in featurize(b.column(1), look, hasher):
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array([",".join(k[lo:hi])]), "y": pa.array([y[lo:hi].tobytes()], pa.binary()),
                    "row": pa.array([row.astype(np.int32).tobytes()], pa.binary()),
                    "feat": pa.array([feat.astype(np.int32).tobytes()], pa.binary()),
                    "val": pa.array([val.astype(np.float32).tobytes()], pa.binary()),
                    "shp": pa.array([shp.astype(np.float32).tobytes()], pa.binary())})

    parts = sample.select("k", "t", "y").mapInArrow(
        run, "k string, y binary, row binary, feat binary, val binary, shp binary").collect()
    parts.sort(key=lambda p: p["k"])       # the fit does not depend on the order of tasks
    y = [np.frombuffer(p["y"], np.int32) for p in parts]
    base = np.concatenate([[0], np.cumsum([len(x) for x in y])]).astype(np.int64)
    cat = lambda xs, kind: np.concatenate([np.zeros(0, kind), *xs])
    return {"y": cat(y, np.int32), "k": np.array([x for p in parts for x in p["k"].split(",")], object),
            "row": cat([np.frombuffer(p["row"], np.int32) + base[i] for i, p in enumerate(parts)], np.int64),
            "feat": cat([np.frombuffer(p["feat"], np.int32) for p in parts], np.int32),
            "val": cat([np.frombuffer(p["val"], np.float32) for p in parts], np.float32),
            "shape": cat([np.frombuffer(p["shp"], np.float32) for p in parts], np.float32).reshape(-1, N_SHAPE)}


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, params: dict[str, np.ndarray], grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            params[k] -= self.rate * (self.m[k] / (1 - 0.9 ** self.t)) / (np.sqrt(self.v[k] / (1 - 0.999 ** self.t)) + 1e-8)
