"""Operator 11: periodic runs of words, by online catching of squares over dyadic blocks.

A run is a stretch of consecutive words with smallest period q, at least
``max(6, 4 q)`` words long, that no neighbouring word extends. ``Catchers``
finds all of them while words are appended, in O(n log n):

* For each power of two m, every completed aligned block of m words is a
  catcher for periods q in [2m, 4m). Each appended word completes one window of
  m words, which is compared (by fingerprint) with the two catchers at such
  distances: a hit says that the block stands again q words further. Fingerprints
  of 2m words come from two of m words. Period 1 compares neighbours.
* Hits of one period in consecutive blocks are one piece, and pieces of
  consecutive appends merge. A run holds at least five such blocks, so shorter
  pieces are dropped.
* A piece inside a run of a smaller period is that run again (Fine and Wilf: its
  period is a multiple). Any other is compared word by word, up to one block
  beyond each end, which gives the exact run: no result rests on a fingerprint.

Texts of a batch are appended one after the other with a separator that is
equal to nothing, a long text in pieces. Memory follows the words of a piece,
or of the longest text.

Cases: a null or empty text has no words and no runs; words are runs of bytes other than
space and 0x09-0x0D, compared exactly; repeated rows are worked one by one; an
empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.bytesops import mix64
from skein.llm.scratch import bound_batches

LEAST_WORDS, LEAST_POWER = 6, 4
PIECE = 1 << 16                     # words appended at once
BLOCKS = 5                          # blocks of m words in any run of a period below 4m, at least
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Level:
    """The catchers of one block length over the fingerprints of all windows of that length."""

    def __init__(self, m: int) -> None:
        self.m = m
        self.base = self.end = 0                      # windows held, and the first not yet seen
        self.held = np.zeros(0, np.uint64)
        self.pieces: list[np.ndarray] = []            # rows (period, first block, last block)

    def append(self, new: np.ndarray) -> np.ndarray:
        """Compare the new windows with the catchers; returns the new fingerprints of windows of 2m words."""
        m, first = self.m, self.end
        self.held = np.concatenate([self.held, new])
        self.end += len(new)
        if m == 1:
            self._match(self.held, 1, first)
        blocks = np.repeat(self.held[::m], m)[:len(self.held)]           # fingerprint of the block each window starts in
        self._match(blocks, 2 * m, first)
        self._match(blocks, 3 * m, first)
        a = max(first - m - self.base, 0)
        wide = self.held[a:max(len(self.held) - m, a)] * np.uint64(0x9E3779B97F4A7C15) + self.held[a + m:]
        wide ^= wide >> np.uint64(32)
        wide *= np.uint64(0xD6E8FEB86659FD93)
        wide ^= wide >> np.uint64(29)
        keep = max((self.end - 4 * m) // m * m, self.base)
        self.held, self.base = self.held[keep - self.base:].copy(), keep
        return wide

    def _match(self, blocks: np.ndarray, back: int, first: int) -> None:
        m = self.m
        lo = max(first - self.base, back)
        if lo >= len(blocks):
            return
        hit = self.held[lo:] == blocks[lo - back:len(blocks) - back]
        if not hit.any():
            return
        edge = min(m, len(hit))
        begin, close = hit.copy(), hit.copy()
        begin[edge:] &= ~hit[:-edge] if len(hit) > edge else True
        close[:-edge] &= ~hit[edge:] if len(hit) > edge else True
        s, e = np.flatnonzero(begin) + lo + self.base, np.flatnonzero(close) + lo + self.base
        s, e = s[np.argsort(s % m, kind="stable")], e[np.argsort(e % m, kind="stable")]
        q = back + (s % m if back > 1 else 0 * s)
        # a short piece stays only where it may go on in an append before or after
        some = (e - s >= (BLOCKS - 1) * m) | (s - m < lo + self.base) | (e + m >= self.end)
        self.pieces.append(np.stack([q, s - q, e - q])[:, some])

    def merged(self) -> np.ndarray:
        """Pieces over all appends, those of one period in consecutive blocks as one."""
        p = np.concatenate([np.zeros((3, 0), np.int64), *self.pieces], axis=1)
        p = p[:, np.lexsort((p[1], p[0]))]
        new = np.ones(p.shape[1], bool)
        new[1:] = (p[0, 1:] != p[0, :-1]) | (p[1, 1:] != p[2, :-1] + self.m)
        at = np.flatnonzero(new)
        last = np.append(at[1:], p.shape[1]) - 1 if len(at) else at
        p = np.stack([p[0, at], p[1, at], p[2, last]])
        return p[:, p[2] - p[1] >= (BLOCKS - 1) * self.m]


class Catchers:
    """Runs of a sequence of word numbers that grows by ``append``. ``longest``: no run will be longer."""

    def __init__(self, longest: int | None = None) -> None:
        self.longest = longest
        self.levels = [Level(1)]
        self.words: list[np.ndarray] = []

    def append(self, words: np.ndarray) -> None:
        self.words.append(words)
        new = mix64(words.astype(np.uint64) + np.uint64(1))
        k = 0
        while len(new):
            if k == len(self.levels):
                m = 1 << k
                if self.longest is not None and 2 * m * LEAST_POWER > self.longest:
                    return
                self.levels.append(Level(m))
            new = self.levels[k].append(new)
            k += 1

    def runs(self) -> list[tuple[int, int, int]]:
        """(start, length, period) of every run of the words so far, by start and period."""
        w = np.concatenate(self.words) if self.words else np.zeros(0, np.int64)
        found: set[tuple[int, int, int]] = set()
        for level in self.levels:
            m = level.m
            known = np.array(sorted((a, a + n) for a, n, _ in found), np.int64).reshape(-1, 2)
            reach = np.maximum.accumulate(known[:, 1]) if len(known) else known[:, 1]
            q, first, last = level.merged()
            before = np.searchsorted(known[:, 0], first, "right") - 1
            inside = (before >= 0) & (np.append(reach, 0)[before] >= last + m + q)
            for p, a, z in zip(q[~inside].tolist(), first[~inside].tolist(), last[~inside].tolist(), strict=True):
                lo, hi = max(a - m, 0), min(z + 2 * m, len(w) - p)
                same = np.concatenate([[False], w[lo:hi] == w[lo + p:hi + p], [False]])
                edges = np.flatnonzero(same[1:] != same[:-1])
                for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                    length = e - s + p
                    if length >= max(LEAST_WORDS, LEAST_POWER * p):
                        found.add((lo + s, length, p))
        least: dict[tuple[int, int], int] = {}
        for a, n, p in found:
            least[a, n] = min(p, least.get((a, n), p))
        return sorted((a, n, p) for (a, n), p in least.items())


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """Runs of each text (a list of words)."""
    out: list[list[tuple[int, int, int]]] = []
    lo = 0
    while lo < len(texts):
        hi, size = lo + 1, len(texts[lo])
        while hi < len(texts) and size + len(texts[hi]) <= PIECE:
            size += len(texts[hi])
            hi += 1
        catch = Catchers(max(len(t) for t in texts[lo:hi]))
        number: dict[bytes, int] = {}
        starts, parts, at = [], [], 0
        for i in range(lo, hi):
            starts.append(at)
            for a in range(0, len(texts[i]), PIECE):
                parts.append(np.array([number.setdefault(w, len(number)) for w in texts[i][a:a + PIECE]], np.int64))
            parts.append(np.array([-2 - i], np.int64))                 # the separator of this text
            at += len(texts[i]) + 1
        if hi - lo > 1:
            parts = [np.concatenate(parts)]
        for p in parts:
            catch.append(p)
        per: list[list] = [[] for _ in range(hi - lo)]
        for a, n, p in catch.runs():
            i = int(np.searchsorted(starts, a, "right")) - 1
            per[i].append((a - starts[i], n, p))
        out += per
        lo = hi
    return out


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """Words but for those that any run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, np.int64)
    for a, n, p in runs:
        depth[a + p] += 1
        depth[a + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


def split_words(key, raw: bytes) -> list[bytes]:
    return raw.split()                                # at space and 0x09-0x0D


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text",
           words: Callable[[object, bytes], list[bytes]] = split_words) -> DataFrame:
    """(key, n_words, runs array<struct<start, length, period>> by start and period, collapsed), one row per input row.

    ``collapsed`` is the text with each run cut to its first period (words joined by one space). ``words`` gives the words
    of a row from its key and its UTF-8 text."""
    bound_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        item = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for b in batches:
            raw = b.column(1).cast(pa.string()).view(pa.binary()).to_pylist()
            texts = [words(k, r or b"") for k, r in zip(b.column(0).to_pylist(), raw, strict=True)]
            runs = find_runs(texts)
            short = [b" ".join(kept_words(t, r)) for t, r in zip(texts, runs, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([[{"start": a, "length": n, "period": p} for a, n, p in r] for r in runs], item),
                 pa.array(short, pa.binary()).view(pa.string())], names=[key, "n_words", "runs", "collapsed"])

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(
        run, f"`{key}` {kind}, n_words bigint, runs {RUNS}, collapsed string")


def strongest(runs: Column) -> Column:
    """The run of greatest length / period (compared exactly), of equals the first; null without runs."""
    return F.aggregate(F.slice(runs, 2, F.greatest(F.size(runs), F.lit(1))), F.get(runs, F.lit(0)),
                       lambda best, x: F.when(x["length"] * best["period"] > best["length"] * x["period"], x).otherwise(best))
