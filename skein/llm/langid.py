"""Operator 5: language identification with language-bitmask n-gram filters.

A bit-sliced Bloom filter answers, for one n-gram, with the set of *all*
languages that contain it: slot h holds one bit per language (slices of eight
languages), and the AND over the n-gram's slots is its language bitmask. A
text's bitmasks are counted per language; every count is corrected for the
filter's false positives, (hits/n - fp) / (1 - fp), and the greatest share of
contained n-grams decides (ties: the smaller language name).

A language contains an n-gram when at least ``min_docs`` of its training
documents hold it and its rate there is at least ``share`` of its greatest
rate in any language. Training counts the n-grams of every document with a
language, and keeps the ``max_grams`` most frequent that a language contains
per size.

n-grams are 3 and 4 bytes of the folded text (A-Z and the Latin-1 capitals to
lower case, other ASCII non-letters to a space), within one word and its two
bounding spaces. Cases: a null text or one without letters is ``und`` with
score 0; so is everything when nothing could be learned; a text whose n-grams
no language contains gets the first language with score 0; repeated rows are
judged one by one; columns other than the named ones are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from skein.llm.bytesops import row_chunks, text_arrays
from skein.llm.scratch import bound_batches

SIZES = (3, 4)
HASHES = 3
LOG2_SLOTS = 20
MAX_LANGUAGES = 256
HELD = 1 << 18             # counts that a task holds
_MULT = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def _fold() -> np.ndarray:
    t = np.full(256, 32, np.uint8)
    t[128:] = np.arange(128, 256)
    t[97:123] = np.arange(97, 123)
    t[65:91] = np.arange(97, 123)
    return t


def grams(data: np.ndarray, off: np.ndarray, size: int, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, code) of every n-gram of ``size`` bytes; each row is framed by spaces."""
    n_rows = len(off) - 1
    a = np.insert(fold[data], off[:-1], 32) if n_rows else np.zeros(0, np.uint8)
    a = np.append(a, np.uint8(32))
    start = off[:-1] + np.arange(n_rows)
    # a Latin-1 capital is C3 80..9E (but for the multiplication sign)
    big = np.flatnonzero(a[:-1] == 0xC3) + 1
    if len(big):
        c = a[big]
        a[big] = np.where((c >= 0x80) & (c <= 0x9E) & (c != 0x97), c + 32, c)
    m = len(a) - size + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    space = a == 32
    ok = ~space[1:m + 1]
    for k in range(2, size - 1):
        ok &= ~space[k:m + k]
    at = np.flatnonzero(ok)
    code = np.full(len(at), size, np.uint64)
    for k in range(size):
        code = (code << np.uint64(8)) | a[at + k]
    bounds = np.searchsorted(at, np.append(start, len(a)))
    return np.repeat(np.arange(n_rows), np.diff(bounds)), code


def slots(code: np.ndarray, log2_slots: int) -> Iterator[np.ndarray]:
    for k in range(HASHES):
        yield ((code ^ (code >> np.uint64(15))) * _MULT[k]) >> np.uint64(64 - log2_slots)


def has_letter(texts, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Rows with at least one Unicode letter."""
    ascii_letter = ((data | 32) >= 97) & ((data | 32) <= 122)
    c = np.concatenate([[0], np.cumsum(ascii_letter)])
    out = c[off[1:]] > c[off[:-1]]
    for i in np.flatnonzero(~out & (off[1:] > off[:-1])):
        out[i] = any(ch.isalpha() for ch in texts[int(i)].as_py())
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", min_docs: int = 2, share: float = 0.25,
        max_grams: int = 30_000, log2_slots: int = LOG2_SLOTS) -> dict:
    """Learn the filter from all documents with a text and a language. Returns a small dict: languages, slices,
    false-positive rates."""
    bound_batches(docs.sparkSession)
    known = docs.select(F.col(text).cast("string").alias("t"), F.col(lang).cast("string").alias("l")) \
        .filter("l is not null and t is not null")
    sizes = {r["l"]: r["n"] for r in known.groupBy("l").count().withColumnRenamed("count", "n")
             .orderBy(F.desc("n"), "l").limit(MAX_LANGUAGES + 1).collect()}
    if len(sizes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "log2": log2_slots, "slices": np.zeros((0, 1 << log2_slots), np.uint8), "fp": np.zeros(0)}
    fold = _fold()

    def count(batches):
        """Counts of a task, added up before they leave it as far as ``HELD`` of them go."""
        import pyarrow as pa
        kept, held = {}, 0

        def added(parts):
            code, inv = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            return (code, *[np.bincount(inv, np.concatenate([p[i] for p in parts]), len(code)).astype(np.int64) for i in (1, 2)])

        def drain():
            for name, parts in kept.items():
                code, n, d = added(parts)
                for lo in range(0, len(code), HELD):
                    part = slice(lo, lo + HELD)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(code[part])), pa.array(np.where(code[part] >> np.uint64(24) == 3, 3, 4).astype(np.int32)),
                         pa.array(code[part].astype(np.int64)), pa.array(n[part]), pa.array(d[part])], names=["l", "size", "g", "n", "d"])

        for b in batches:
            data, off = text_arrays(b.column(1))
            ls = b.column(0).to_pylist()
            for lo, hi in row_chunks(off):
                part = data[off[lo]:off[hi]]
                o = off[lo:hi + 1] - off[lo]
                names = sorted(set(ls[lo:hi]))
                ix = np.array([names.index(x) for x in ls[lo:hi]])
                for size in SIZES:
                    row, code = grams(part, o, size, fold)
                    packed, n = np.unique((code << np.uint64(24)) | row.astype(np.uint64), return_counts=True)
                    c, r = packed >> np.uint64(24), packed & np.uint64((1 << 24) - 1)
                    l_of = ix[r.astype(np.int64)]
                    for j, name in enumerate(names):
                        m = l_of == j
                        cu, first = np.unique(c[m], return_index=True)
                        if len(cu):
                            kept.setdefault(name, []).append((cu, np.add.reduceat(n[m], first), np.diff(np.append(first, m.sum()))))
                            held += len(cu)
            if held > 2 * HELD:
                kept = {name: [added(parts)] for name, parts in kept.items()}
                held = sum(len(p[0][0]) for p in kept.values())
                if held > HELD:
                    yield from drain()
                    kept, held = {}, 0
        yield from drain()

    per = known.select("l", "t").mapInArrow(count, "l string, size int, g long, n long, d long") \
        .groupBy("l", "size", "g").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))
    total = per.groupBy("l", "size").agg(F.sum("n").alias("total"))
    rated = per.join(F.broadcast(total), ["l", "size"])      # at most MAX_LANGUAGES x sizes rows
    rated = rated.withColumn("r", F.col("n") / F.col("total")) \
        .withColumn("top", F.max("r").over(W.partitionBy("g"))) \
        .filter((F.col("r") >= share * F.col("top")) & (F.col("d") >= min_docs)) \
        .withColumn("rn", F.row_number().over(W.partitionBy("l", "size").orderBy(F.desc("n"), "g"))) \
        .filter(F.col("rn") <= max_grams).select("l", "g")
    got = rated.toPandas()                                    # bounded: languages x sizes x max_grams
    slices = np.zeros(((len(langs) + 7) // 8, 1 << log2_slots), np.uint8)
    fp = np.zeros(len(langs))
    for i, name in enumerate(langs):
        code = got.loc[got["l"] == name, "g"].to_numpy().astype(np.uint64)
        bit = np.uint8(1 << (i % 8))
        for s in slots(code, log2_slots):
            slices[i // 8, s] |= bit
        fp[i] = float(((slices[i // 8] & bit) > 0).mean()) ** HASHES
    return {"langs": langs, "log2": log2_slots, "slices": slices, "fp": fp}


def predict(model: dict, col) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index or -1, score, n-grams) for every text of an Arrow column."""
    langs, slices, fp = model["langs"], model["slices"], model["fp"]
    data, off = text_arrays(col)
    n = len(off) - 1
    hits, total = np.zeros((n, len(langs))), np.zeros(n)
    fold = _fold()
    bits = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.float64)
    for lo, hi in row_chunks(off):
        part, o, rows = data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo], hi - lo
        for size in SIZES:
            row, code = grams(part, o, size, fold)
            total[lo:hi] += np.bincount(row, minlength=rows)
            where = list(slots(code, model["log2"]))
            for s in range(len(slices)):
                mask = slices[s][where[0]]
                for w in where[1:]:
                    mask &= slices[s][w]
                table = np.bincount(row * 256 + mask, minlength=rows * 256).reshape(rows, 256)
                width = min(8, len(langs) - 8 * s)
                hits[lo:hi, 8 * s:8 * s + width] += table @ bits[:, :width]
    if not langs:
        return np.full(n, -1), np.zeros(n), total
    share = np.clip((hits / np.maximum(total, 1)[:, None] - fp) / (1 - np.minimum(fp, 0.999)), 0, 1)
    best = share.argmax(axis=1)
    score = share[np.arange(n), best]
    letters = has_letter(col, data, off)
    return np.where(letters, best, -1), np.where(letters, score, 0.0), total


def identify(docs: DataFrame, model: dict, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """The input rows (all columns, or those in ``keep``) with three more: lang_pred, score, n_grams.

    Raises if a kept column already has one of these names."""
    new = ["lang_pred", "score", "n_grams"]
    kept = list(docs.columns if keep is None else keep)
    docs = docs.select(*kept, *([] if text in kept else [text]))
    taken = [c for c in kept if c.lower() in new]
    if taken:
        raise ValueError(f"columns already present: {taken}")
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few MB at most
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa
        names = np.array([*shared.value["langs"], "und"], object)
        for b in batches:
            best, score, total = predict(shared.value, b.column(at))
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(kept)], pa.array(names[best], pa.string()), pa.array(score),
                 pa.array(total.astype(np.int64))], names=[*kept, *new])

    out = T.StructType([*docs.schema.fields[:len(kept)], T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType()), T.StructField("n_grams", T.LongType())])
    return docs.mapInArrow(run, out)
