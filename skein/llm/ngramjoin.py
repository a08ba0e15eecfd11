"""Operator 2: exact n-gram Jaccard join of whole texts, as components.

A text's set holds its distinct ``size``-word shingles (the whole sequence if
it has fewer words). Two texts link when their sets' Jaccard similarity is at
least ``percent`` / 100. The result is one row per text with its component.

1. Shingles become 64-bit hashes (48 bits travel). Texts with equal sets fall
   together by a 64-bit set signature, so copies are one set from here on.
2. Shingle hashes are dealt to buckets; a bucket finds how many sets hold each
   shingle. Only shingles of two sets or more return to their sets, with that
   frequency: one of a single set can never be shared.
3. Each set is ordered by (frequency, hash), rarest first. Similar sets must
   share a token among their first n - ceil(t*n) + 1 (the prefix), and unique
   tokens come first, so a set with that many unique tokens has no partner.
4. The prefixes make inverted lists. *Answers by set relation*: every list
   names its most central set (fewest unique tokens) as hub, each set is
   checked against the hub it meets most often, and linked sets share the
   hub's answers as one component: pairs inside it need no check.
5. What is left are pairs of different components in one list. They are
   filtered by length and position, a block of the list at a time (a block
   whose best bound misses is skipped whole), and by the bound
   |x & y| <= min(|x & h|, |y & h|) + min(|x \\ h|, |y \\ h|) when both know
   their overlap with one hub h. The rest are verified exactly.

6. Numbers of links, if asked for, are derived from a component's *center* h, the
   hub of most of its sets. Each set is kept as its differences from h, and
   |x & y| = |x & h| + |y & h| - |h| + |h\\x & h\\y| + |x\\h & y\\h|. The first three terms alone
   settle most pairs: sets so close to h that any two of them must link (*inner*
   ones) take each other's number of copies without any comparison; pairs with an outer set
   are counted in blocks, by those bounds and, where they leave it open, by the differences.

No filter drops a pair that links, so components are exact up to 64-bit hash
collisions. Sets stay distributed; tables between steps are in the shared
folder. Hot groups: copies collapse in step 1, near copies in step 4.

Cases: null and empty texts and texts without words have the empty set, link
with nothing and are their own component; repeated rows with one key are
repeated rows of the result; only the key and the text are read.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bytesops import SpanHash, lower_table, mix64, row_chunks, rows_of, seed_table, spans, text_arrays
from skein.llm.scratch import bound_batches, components, save
from skein.session import shuffle_partitions

BUCKET_BYTES = 24 << 20           # text bytes per bucket at most, about
CHUNK = 4 << 20
MAX_ROWS = 1 << 15                # rows of a chunk fit 16 bits
BLOCK = 128
BLOCK_SETS = 256                  # sets of a component in a block, about
SALT_SETS = 1024                  # sets of a component that meet one copy of its center, about
TOKENS = 4096
_ORDER = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                   0xE7037ED1A0B428DB], np.uint64)


def _multipliers(size: int) -> np.ndarray:
    return np.concatenate([_ORDER, mix64(np.arange(1, max(size, 5) + 1, dtype=np.uint64)) | np.uint64(1)])[:size]


def separators() -> np.ndarray:
    m = np.zeros(256, bool)
    m[[32, 9, 10, 11, 12, 13]] = True
    return m


def shingles(data: np.ndarray, off: np.ndarray, size: int, hasher: SpanHash) -> tuple[np.ndarray, np.ndarray]:
    """(row, 64-bit hash) of all shingles, repeats included."""
    s, e = spans(~separators()[data], off)
    row = rows_of(off, s)
    h = hasher(data, s, e, seed_table(lower_table()))
    mult = _multipliers(size)
    n = len(h)
    full = np.flatnonzero(row[size - 1:] == row[:n - size + 1]) if n >= size else np.zeros(0, np.int64)
    g = np.zeros(len(full), np.uint64)
    for j in range(size):
        g += h[full + j] * mult[j]
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.cumsum(count) - count
    short = np.flatnonzero((count > 0) & (count < size))
    gs = count[short].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(size - 1):
        has = count[short] > j
        gs[has] += h[first[short[has]] + j] * mult[j]
    return np.concatenate([row[full], short]), mix64(np.concatenate([g, gs]))


def planes(x: np.ndarray) -> bytes:
    """Sorted 64-bit numbers as byte planes of their differences (they compress well)."""
    d = np.diff(x, prepend=np.uint64(0))
    return np.ascontiguousarray(d.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def unplanes(b: bytes) -> np.ndarray:
    d = np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(8, -1).T).view("<u8").ravel()
    return np.cumsum(d, dtype=np.uint64)


PASS_SCHEMA = "bucket int, key long, n long, sig long, entries binary, owners binary"


def _hash_pass(size: int, buckets: int):
    edges = np.array([(k << 64) // buckets for k in range(1, buckets)], np.uint64)

    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("bucket", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()),
                            ("entries", pa.binary()), ("owners", pa.binary())])
        from pyspark import TaskContext
        context = TaskContext.get()
        turn = 37 * context.partitionId() if context else 0          # text rows go round the buckets
        hasher = SpanHash()
        for b in batches:
            keys = b.column(0)
            all_data, all_off = text_arrays(b.column(1))
            for big_lo, big_hi in row_chunks(all_off, CHUNK):
                for lo in range(big_lo, big_hi, MAX_ROWS):
                    hi = min(lo + MAX_ROWS, big_hi)
                    rows = hi - lo
                    row, g = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
                    part = all_off[lo:hi + 1]
                    for a, z in row_chunks(part):
                        r, x = shingles(all_data[part[a]:part[z]], part[a:z + 1] - part[a], size, hasher)
                        row.append(r + a)
                        g.append(x)
                    r, x = np.concatenate(row), np.concatenate(g)
                    packed = np.sort((x & ~np.uint64(0xFFFF)) | r.astype(np.uint64))
                    if len(packed):
                        packed = packed[np.append(True, packed[1:] != packed[:-1])]
                    owner = (packed & np.uint64(0xFFFF)).astype(np.uint16)
                    n = np.bincount(owner, minlength=rows)
                    raw = np.bincount(r, minlength=rows)
                    for i in np.flatnonzero(raw > 1 << 16):        # 48 bits could merge shingles of a huge set
                        n[i] = len(np.unique(x[r == i]))
                    by = np.argsort(owner, kind="stable")
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix64((packed >> np.uint64(16))[by] + np.uint64(1)),
                                                                      dtype=np.uint64)])
                    cut = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=rows))])
                    sig = mix64(total[cut[1:]] - total[cut[:-1]] + n.astype(np.uint64))
                    sig[n == 0] = 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(((np.arange(lo, hi) + turn) % buckets).astype(np.int32)), keys.slice(lo, rows),
                         pa.array(n.astype(np.int64)), pa.array(sig.view(np.int64)), pa.nulls(rows, pa.binary()),
                         pa.nulls(rows, pa.binary())], schema=schema)
                    ends = np.concatenate([[0], np.searchsorted(packed, edges), [len(packed)]])
                    some = [k for k in range(buckets) if ends[k + 1] > ends[k]]
                    blobs, owners = [], []
                    for k in some:
                        p = packed[ends[k]:ends[k + 1]]
                        who = np.unique(owner[ends[k]:ends[k + 1]])
                        blobs.append(planes(p))
                        owners.append(who.astype("<u2").tobytes() + n[who].astype("<u4").tobytes()
                                      + sig[who].astype("<u8").tobytes())
                    if some:
                        none = pa.nulls(len(some), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(some, pa.int32()), none, none, none, pa.array(blobs, pa.binary()),
                             pa.array(owners, pa.binary())], schema=schema)
    return run


BUCKET_SCHEMA = "part int, key long, n long, sig long, entries binary, owners binary"


def _bucket_pass(parts: int):
    """Per bucket: shingles held by two sets or more, dealt back to the sets. Text rows pass through."""
    def run(batches):
        import pyarrow as pa
        schema = pa.schema([("part", pa.int32()), ("key", pa.int64()), ("n", pa.int64()), ("sig", pa.int64()),
                            ("entries", pa.binary()), ("owners", pa.binary())])
        toks, sigs, sizes = [], [], {}
        n_sig, n_val = [], []
        for b in batches:
            text = b.column(4).is_null()
            plain = b.filter(text)
            if plain.num_rows:
                yield pa.RecordBatch.from_arrays([pa.nulls(plain.num_rows, pa.int32()), *plain.columns[1:]], schema=schema)
            for e, o in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                if e is None:
                    continue
                packed = unplanes(e)
                m = len(o) // 14
                who = np.frombuffer(o, "<u2", m)
                n_sig.append(np.frombuffer(o, "<u8", m, 6 * m))
                n_val.append(np.frombuffer(o, "<u4", m, 2 * m))
                toks.append(packed >> np.uint64(16))
                sigs.append(n_sig[-1][np.searchsorted(who, (packed & np.uint64(0xFFFF)).astype(np.uint16))])
        if not toks:
            return
        tok, sig = np.concatenate(toks), np.concatenate(sigs)
        toks.clear()
        sigs.clear()
        order = np.argsort(tok)
        tok, sig = tok[order], sig[order]
        same = np.append(tok[1:] == tok[:-1], False)
        dup = same | np.append(False, same[:-1])
        tok, sig = tok[dup], sig[dup]
        order = np.lexsort((sig, tok))
        tok, sig = tok[order], sig[order]
        if len(tok):
            new = np.append(True, (tok[1:] != tok[:-1]) | (sig[1:] != sig[:-1]))
            tok, sig = tok[new], sig[new]
        start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1])) if len(tok) else np.zeros(0, np.int64)
        held = np.diff(np.append(start, len(tok)))
        df = np.repeat(held, held)
        keep = df > 1
        tok, sig, df = tok[keep], sig[keep], df[keep]
        key = (np.minimum(df, 0x7FFF).astype(np.uint64) << np.uint64(48)) | tok
        all_sig, all_n = np.concatenate(n_sig), np.concatenate(n_val)
        u, ix = np.unique(all_sig, return_index=True)
        size_of = all_n[ix]
        home = (sig % np.uint64(parts)).astype(np.int64)
        order = np.lexsort((key, sig, home))
        key, sig, home = key[order], sig[order], home[order]
        for k in np.unique(home):
            a, z = np.searchsorted(home, k), np.searchsorted(home, k, "right")
            who, count = np.unique(sig[a:z], return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(k)], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                 pa.array([key[a:z].astype("<u8").tobytes()], pa.binary()),
                 pa.array([who.astype("<u8").tobytes() + size_of[np.searchsorted(u, who)].astype("<u4").tobytes()
                           + count.astype("<u4").tobytes()], pa.binary())], schema=schema)
    return run


def need_of(n, percent: int):
    """Fewest members of a set of n that any similar set must share."""
    return -(-percent * n // 100)


def _set_pass(percent: int):
    """Per set: its shared tokens in order, if enough of them are shared for any link."""
    def run(batches):
        import pyarrow as pa
        keys, sigs, us, ns = [], [], [], []
        for b in batches:
            for e, o in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                m = len(o) // 16
                who = np.frombuffer(o, "<u8", m)
                us.append(who)
                ns.append(np.frombuffer(o, "<u4", m, 8 * m))
                keys.append(np.frombuffer(e, "<u8"))
                sigs.append(np.repeat(who, np.frombuffer(o, "<u4", m, 12 * m)))
        if not keys:
            return
        key, sig = np.concatenate(keys), np.concatenate(sigs)
        u, ix = np.unique(np.concatenate(us), return_index=True)
        n = np.concatenate(ns)[ix].astype(np.int64)
        order = np.lexsort((key, sig))
        key, sig = key[order], sig[order]
        a = np.searchsorted(sig, u)
        z = np.searchsorted(sig, u, "right")
        alive = np.flatnonzero(z - a >= need_of(n, percent))
        for lo in range(0, len(alive), 256):
            i = alive[lo:lo + 256]
            lists = [key[a[j]:z[j]].view(np.int64) for j in i]
            cut = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
            flat = np.concatenate([np.zeros(0, np.int64), *lists])
            yield pa.RecordBatch.from_arrays(
                [pa.array(u[i].view(np.int64)), pa.array(n[i]), pa.ListArray.from_arrays(pa.array(cut), pa.array(flat))],
                names=["sig", "n", "toks"])
    return run


def _list_pairs(percent: int):
    """Pairs of different components within one inverted list that pass every bound.

    Rows come sorted by (tok, n); a list may span batches."""
    def pairs_of(sig, n, at, comp, hub, inter):
        if (comp == comp[0]).all():
            return
        rest = n - at                                    # tokens from this one on
        blocks = range(0, len(sig), BLOCK)
        b_rest = np.array([rest[i:i + BLOCK].max() for i in blocks])
        b_n = np.array([n[i:i + BLOCK].min() for i in blocks])
        for i in range(len(sig) - 1):
            top = int(np.searchsorted(n, n[i] * 100 // percent, "right"))     # length filter
            if top <= i + 1:
                continue
            first, last = (i + 1) // BLOCK, (top - 1) // BLOCK
            best = np.minimum(rest[i], b_rest[first:last + 1])
            least = need_pair(n[i], np.maximum(b_n[first:last + 1], n[i]), percent)
            for k in np.flatnonzero(best >= least) + first:                   # block skipping
                j = np.arange(max(i + 1, k * BLOCK), min(top, (k + 1) * BLOCK))
                j = j[comp[j] != comp[i]]
                need = need_pair(n[i], n[j], percent)
                ok = np.minimum(rest[i], rest[j]) >= need
                bound = np.minimum(inter[i], inter[j]) + np.minimum(n[i] - inter[i], n[j] - inter[j])
                ok &= (hub[j] != hub[i]) | (bound >= need)
                j = j[ok]
                if len(j):
                    yield np.minimum(sig[i], sig[j]), np.maximum(sig[i], sig[j])

    def run(batches):
        import pyarrow as pa
        carry = None
        out_a, out_b, held = [], [], 0

        def emit():
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_a)), pa.array(np.concatenate(out_b))],
                                              names=["a", "b"])

        def lists():
            nonlocal carry
            for b in batches:
                cols = np.stack([c.to_numpy() for c in b.columns])
                if carry is not None:
                    cols = np.concatenate([carry, cols], axis=1)
                cut = np.append(np.flatnonzero(np.append(True, cols[0, 1:] != cols[0, :-1])), cols.shape[1])
                for lo, hi in zip(cut[:-2], cut[1:-1], strict=True):
                    yield cols[:, lo:hi]
                carry = cols[:, cut[-2]:]
            if carry is not None:
                yield carry

        for c in lists():
            if c.shape[1] > 1:
                for a, b in pairs_of(*c[1:]):
                    out_a.append(a)
                    out_b.append(b)
                    held += len(a)
                    if held > 100_000:
                        yield emit()
                        out_a, out_b, held = [], [], 0
        if held:
            yield emit()
    return run


def need_pair(n, m, percent: int):
    """Fewest shared members for sets of n and m: 100 i >= percent (n + m - i)."""
    return -(-percent * (n + m) // (100 + percent))


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, inter, linked) by exact intersection of the two sets."""
    left = sets.select(F.col("sig").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = sets.select(F.col("sig").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    inter = F.size(F.array_intersect("ta", "tb")).cast("bigint")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "na", "nb", inter.alias("inter")) \
        .withColumn("linked", 100 * F.col("inter") >= percent * (F.col("na") + F.col("nb") - F.col("inter"))) \
        .select("a", "b", "inter", "linked")


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of every left with every right set of tokens."""
    out = np.zeros((len(left), len(right)), np.int64)
    lt, rt = np.concatenate([np.zeros(0, np.int64), *left]), np.concatenate([np.zeros(0, np.int64), *right])
    both = np.intersect1d(lt, rt)
    if not len(both):
        return out

    def cells(tok, sets):
        row = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
        at = np.minimum(np.searchsorted(both, tok), len(both) - 1)
        hit = both[at] == tok
        order = np.argsort(at[hit], kind="stable")
        return at[hit][order], row[hit][order]

    (la, lr), (ra, rr) = cells(lt, left), cells(rt, right)
    for lo in range(0, len(both), TOKENS):
        dense = []
        for at, row, m in ((la, lr, len(left)), (ra, rr, len(right))):
            i, j = np.searchsorted(at, [lo, lo + TOKENS])
            x = np.zeros((m, min(TOKENS, len(both) - lo)), np.float32)
            x[row[i:j], at[i:j] - lo] = 1
            dense.append(x)
        out += (dense[0] @ dense[1].T).astype(np.int64)         # at most TOKENS: exact in 32 bits
    return out


def linked_pairs(nx, ix, dx, ax, ny, iy, dy, ay, u: int, percent: int) -> np.ndarray:
    """Which sets of two blocks link, from sizes, overlaps with the center (``u`` tokens) and differences from it."""
    need = need_pair(nx[:, None], ny[None, :], percent)
    least = ix[:, None] + iy[None, :] - u
    link = least >= need
    size = [np.array([len(t) for t in x], np.int64) for x in (dx, dy, ax, ay)]
    most = least + np.minimum(size[0][:, None], size[1][None, :]) + np.minimum(size[2][:, None], size[3][None, :])
    unsettled = ~link & (most >= need)
    rows, cols = np.flatnonzero(unsettled.any(axis=1)), np.flatnonzero(unsettled.any(axis=0))
    if len(rows):
        inter = least[np.ix_(rows, cols)] + _common([dx[i] for i in rows], [dy[j] for j in cols]) \
            + _common([ax[i] for i in rows], [ay[j] for j in cols])
        link[np.ix_(rows, cols)] |= inter >= need[np.ix_(rows, cols)]
    return link


def _block_links(percent: int):
    """Per pair of blocks of one component: how many documents of the other block each set links with."""
    def run(table):
        import pyarrow as pa
        table = table.combine_chunks()
        side = table.column("side").to_numpy()
        cols = {c: table.column(c).to_numpy() for c in ("sig", "n", "ix", "w")}
        lists = {}
        for c in ("d", "a"):
            arr = table.column(c).combine_chunks()
            off, flat = arr.offsets.to_numpy(), arr.values.to_numpy()
            lists[c] = [flat[off[i]:off[i + 1]] for i in range(len(arr))]
        u = int(table.column("u")[0].as_py())
        one = bool(table.column("same")[0].as_py())
        x = np.arange(len(side)) if one else np.flatnonzero(side == 0)
        y = x if one else np.flatnonzero(side == 1)
        link = linked_pairs(cols["n"][x], cols["ix"][x], [lists["d"][i] for i in x], [lists["a"][i] for i in x],
                            cols["n"][y], cols["ix"][y], [lists["d"][i] for i in y], [lists["a"][i] for i in y], u, percent)
        if one:
            np.fill_diagonal(link, False)
        got = [(cols["sig"][x], link @ cols["w"][y])]
        if not one:
            got.append((cols["sig"][y], cols["w"][x] @ link))
        return pa.table({"sig": pa.array(np.concatenate([a for a, _ in got])),
                         "k": pa.array(np.concatenate([b for _, b in got]).astype(np.int64))})
    return run


def _link_counts(whole: DataFrame, checked: DataFrame, sets: DataFrame, copies: DataFrame, percent: int) -> DataFrame:
    """(sig, links): documents of other sets that a set of a component (node, root) links with; ``copies`` has (sig, w)."""
    votes = checked.filter("linked").groupBy("b").agg(F.count(F.lit(1)).alias("k"))
    best = votes.join(whole, F.col("b") == F.col("node")).groupBy("root").agg(F.max_by("b", F.struct("k", "b")).alias("hub"))
    centers = whole.groupBy("root").agg(F.count(F.lit(1)).alias("m")).join(best, "root", "left") \
        .select("root", "m", F.coalesce("hub", "root").alias("center"))

    def salts(m):
        return F.greatest(F.lit(1), F.ceil(m / F.lit(SALT_SETS))).cast("int")

    def salted(df):                                 # a row for each salt of a component
        return df.withColumn("salt", F.explode(F.sequence(F.lit(0), salts(F.col("m")) - 1)))
    heads = salted(centers.join(sets.select(F.col("sig").alias("center"), F.col("toks").alias("h")), "center")) \
        .select("root", "salt", "h")
    member = whole.join(centers.select("root", "m"), "root") \
        .select(F.col("node").alias("sig"), "root", "m", F.pmod(F.xxhash64("node"), salts(F.col("m"))).cast("int").alias("salt"))
    total = F.lit(100 + percent)
    placed = member.join(sets, "sig").join(copies, "sig").join(heads, ["root", "salt"]).select(
        "sig", "root", "m", "salt", F.col("n").cast("long").alias("n"), F.col("w").cast("long").alias("w"),
        F.size("h").cast("long").alias("u"), F.array_except("h", "toks").alias("d"), F.array_except("toks", "h").alias("a")) \
        .withColumn("ix", F.col("u") - F.size("d")) \
        .withColumn("inner", 2 * (total * F.col("ix") - F.lit(percent) * F.col("n")) >= total * F.col("u"))
    placed = save(placed, "differences")
    blocks = F.ceil(F.count_if(F.col("inner")) / F.lit(BLOCK_SETS)).cast("int")
    stats = placed.groupBy("root").agg(
        F.max("m").alias("m"), F.sum("w").alias("w_all"), F.sum(F.when(F.col("inner"), F.col("w"))).alias("w_inner"),
        F.ceil(F.count_if(~F.col("inner")) / F.lit(BLOCK_SETS)).cast("int").alias("outs"), blocks.alias("ins"))
    known = placed.join(salted(stats).drop("m"), ["root", "salt"])
    # Two sets of a component link; inner ones link with each other.
    sure = known.select("sig", F.when(F.col("m") == 2, F.col("w_all") - F.col("w"))
                        .when(F.col("inner"), F.col("w_inner") - F.col("w")).otherwise(F.lit(0)).alias("k"))
    at = F.pmod(F.xxhash64("sig", F.lit(1)), F.when(F.col("inner"), F.col("ins")).otherwise(F.col("outs"))).cast("int")

    def steps(n):
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    meets = F.when(F.col("inner"), F.transform(steps(F.col("outs")), lambda j: F.struct(
        F.lit(1).alias("kind"), j.alias("i"), F.col("at").alias("j"), F.lit(1).alias("side")))).otherwise(F.concat(
            F.transform(steps(F.col("outs")), lambda j: F.struct(
                F.lit(0).alias("kind"), F.least("at", j).alias("i"), F.greatest("at", j).alias("j"),
                (F.col("at") > j).cast("int").alias("side"))),
            F.transform(steps(F.col("ins")), lambda j: F.struct(
                F.lit(1).alias("kind"), F.col("at").alias("i"), j.alias("j"), F.lit(0).alias("side")))))
    dealt = known.filter("m > 2").withColumn("at", at).withColumn("meet", F.explode(meets)).select(
        "root", "meet.kind", "meet.i", "meet.j", "meet.side", "sig", "n", "ix", "w", "u", "d", "a",
        ((F.col("meet.kind") == 0) & (F.col("meet.i") == F.col("meet.j"))).alias("same"))
    counted = dealt.groupBy("root", "kind", "i", "j").applyInArrow(_block_links(percent), "sig long, k long")
    return sure.unionByName(counted).groupBy("sig").agg(F.sum("k").cast("long").alias("links"))


def join_texts(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5,
               percent: int = 75, links: bool = False) -> DataFrame:
    """(key, n_shingles, component_id): one row per input row; component_id is the
    smallest key reachable by links, the own key included. With ``links`` also
    n_links: the number of other rows that the row links with directly."""
    if not 50 < percent <= 100 or size < 1:
        raise ValueError("percent must be over 50 and at most 100, size at least 1")
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).cast("string").alias("t"))
    volume = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    buckets = max(shuffle_partitions(spark), math.ceil(volume / BUCKET_BYTES))
    hashed = rows.mapInArrow(_hash_pass(size, buckets), PASS_SCHEMA) \
        .repartitionById(buckets, F.col("bucket")).mapInArrow(_bucket_pass(buckets), BUCKET_SCHEMA)
    hashed = save(hashed, "shingles")
    texts = hashed.filter("part is null").select("key", "n", "sig")
    sets = hashed.filter("part is not null").select("part", "entries", "owners") \
        .repartitionById(buckets, F.col("part")).mapInArrow(_set_pass(percent), "sig long, n long, toks array<long>")
    sets = save(sets, "sets")

    need = F.ceil(F.col("n") * percent / 100).cast("int")
    lists = sets.select("sig", "n", F.size("toks").alias("u"),
                        F.posexplode(F.slice("toks", 1, F.size("toks") - need + 1)).alias("p", "tok")) \
        .select("tok", "sig", "n", (F.col("n") - F.col("u") + F.col("p")).alias("at"), (F.col("n") - F.col("u")).alias("own"))

    # Hubs: the most central set of each list, then the hub a set meets most often.
    central = lists.groupBy("tok").agg(F.min(F.struct("own", "n", "sig")).alias("h"), F.count(F.lit(1)).alias("k")) \
        .filter("k > 1").select("tok", F.col("h.sig").alias("hub"))
    met = lists.join(central, "tok").filter("hub <> sig").groupBy("sig", "hub").agg(F.count(F.lit(1)).alias("k"))
    hubs = met.groupBy("sig").agg(F.max_by("hub", F.struct("k", "hub")).alias("hub"))
    checked = save(_verify(hubs.select(F.col("sig").alias("a"), F.col("hub").alias("b")), sets, percent), "hubs")
    first = components(checked.filter("linked"))

    # Pairs of different components left in one list, bounded by blocks, positions and hub overlaps.
    known = checked.select(F.col("a").alias("sig"), F.col("b").alias("hub"), "inter")
    tagged = lists.select("tok", "sig", "n", "at") \
        .join(first.select(F.col("node").alias("sig"), "root"), "sig", "left").join(known, "sig", "left") \
        .select("tok", "sig", "n", F.col("at").cast("bigint"), F.coalesce("root", "sig").alias("comp"),
                F.coalesce("hub", "sig").alias("hub"), F.coalesce("inter", "n").alias("inter"))
    mixed = tagged.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x <> y").select("tok")
    pairs = tagged.join(mixed, "tok", "left_semi").repartition("tok").sortWithinPartitions("tok", "n", "at", "sig") \
        .mapInArrow(_list_pairs(percent), "a long, b long").distinct()
    tried = checked.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    second = _verify(pairs.join(tried, ["a", "b"], "left_anti"), sets, percent).filter("linked").select("a", "b")
    whole = components(save(second.unionByName(checked.filter("linked").select("a", "b")), "links"))

    # Back to keys: the smallest key of a set, then of its component.
    least = texts.filter("n > 0").groupBy("sig").agg(F.min("key").alias("least"))
    member = whole.join(least, F.col("node") == F.col("sig")).select("sig", "root", "least")
    of_root = member.groupBy("root").agg(F.min("least").alias("low"))
    low = member.join(of_root, "root").select("sig", "low")
    per_set = least.join(low, "sig", "left").select("sig", F.coalesce("low", "least").alias("component_id"))
    more = []
    if links:
        copies = texts.filter("n > 0").groupBy("sig").agg(F.count(F.lit(1)).alias("w"))
        counts = _link_counts(whole, checked, sets, copies, percent)
        per_set = per_set.join(copies, "sig").join(counts, "sig", "left") \
            .select("sig", "component_id", (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("k"))
        more = [F.coalesce("k", F.lit(0)).alias("n_links")]
    per_set = per_set.withColumnRenamed("sig", "_s")
    return texts.join(per_set, (F.col("sig") == F.col("_s")) & (F.col("n") > 0), "left") \
        .select(F.col("key").alias(key), F.col("n").alias("n_shingles"),
                F.coalesce("component_id", "key").alias("component_id"), *more)
