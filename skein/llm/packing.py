"""Operator 8: order-preserving packing of documents into token windows.

Texts are encoded with a public word BPE vocabulary, one end token is added to
each document, and every task lays its documents out in input order. Windows
of at most ``size`` tokens are cut by dynamic programming over cut points at
document ends, sentence ends, clause ends (truncation within a sentence) and,
inside longer clauses, every ``STEP`` tokens, minimising

    sum of (size - length of the window) + penalty of the cut at its end.

With f(j) the best cost of cutting at point j and x its position,
f(j) = pen(j) + size - x(j) + min over x(i) >= x(j) - size of f(i) + x(i):
a sliding-window minimum, kept in a monotone queue. Finished windows leave a
task's buffer early, so memory is bounded by ``FLUSH`` tokens and one document.
The last, partly filled window of a task is cut into powers of two, which
need no padding.

Encoding is exact and fast: every distinct word is encoded once per worker
process and found again by its 64-bit hash; texts with characters or
contractions outside the plain set are encoded whole by the tokenizer.

Cases: null is the empty text, which is its end token alone; repeated rows and
keys are packed one by one; an empty table gives an empty result; documents
longer than a window are cut; only the key and the text are read. The layout
follows the input's partitions; a retried task lays its rows out the same way.
"""

from __future__ import annotations

from collections import deque

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bytesops import SpanHash, row_chunks, rows_of, seed_table, text_arrays
from skein.llm.scratch import bound_batches

SIZE = 4096
END_ID = 2                       # fixed by the contract
SENTENCE_PENALTY, CLAUSE_PENALTY, INSIDE_PENALTY = 8, 16, 64
STEP = 64
FLUSH = 1 << 20
MAX_WORDS = 1_500_000            # distinct words a worker remembers; beyond, it starts anew
SPACE, LETTER, DIGIT, OTHER, UNSAFE = range(5)


def _classes() -> np.ndarray:
    c = np.full(256, UNSAFE, np.uint8)
    c[33:127] = OTHER
    c[[9, 10, 13, 32]] = SPACE
    c[48:58] = DIGIT
    c[65:91] = c[97:123] = LETTER
    return c


def plain_classes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class per byte, lower-cased bytes, rows that only the tokenizer itself may encode).

    Plain are printable ASCII, Latin-1 letters from U+00C0 on, and the marks
    U+00A1, U+00AB, U+00BB, U+00BF; an apostrophe before a letter that could
    begin a contraction makes a row unsafe, as does ``<|``."""
    cls = _classes()[data]
    low = data.copy()
    up = (data >= 65) & (data <= 90)
    low[up] += 32
    n = len(data)
    lead = np.flatnonzero(data[:-1] == 0xC3) if n else np.zeros(0, np.int64)
    nxt = data[lead + 1] if n else lead
    good = (nxt >= 0x80) & (nxt <= 0xBF) & (nxt != 0x97) & (nxt != 0xB7)
    lead, nxt = lead[good], nxt[good]
    cls[lead] = cls[lead + 1] = LETTER
    low[lead + 1] = np.where(nxt <= 0x9E, nxt + 32, nxt)
    lead = np.flatnonzero(data[:-1] == 0xC2) if n else np.zeros(0, np.int64)
    lead = lead[np.isin(data[lead + 1], [0xA1, 0xAB, 0xBB, 0xBF])] if len(lead) else lead
    cls[lead] = cls[lead + 1] = OTHER
    odd = np.flatnonzero(cls == UNSAFE)
    if n:
        quote = np.flatnonzero(data[:-1] == 39)
        quote = quote[np.isin(low[quote + 1], np.frombuffer(b"strvmld", np.uint8))]
        mark = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        odd = np.concatenate([odd, quote, mark])
    bad = np.zeros(len(off) - 1, bool)
    bad[rows_of(off, odd)] = True
    return cls, low, bad


class Encoder:
    """Ids of whole texts, equal to the tokenizer's, by remembered words."""

    BITS = 21

    def __init__(self, spec: str) -> None:
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        vocab = self.tok.get_vocab()
        self.ends_word = np.zeros(max(vocab.values()) + 1, bool)
        for token, i in vocab.items():
            self.ends_word[i] = token.endswith("</w>")
        self.penalty = np.full(len(self.ends_word), -1, np.int64)      # of a cut after an id; -1: none
        for marks, penalty in ((",;:", CLAUSE_PENALTY), (".!?", SENTENCE_PENALTY)):
            for t in marks:
                if t + "</w>" in vocab:
                    self.penalty[vocab[t + "</w>"]] = penalty
        self.hasher, self.seeds = SpanHash(), seed_table()
        self._forget()

    def _forget(self) -> None:
        self.key = np.zeros((2, 1 << self.BITS), np.uint64)
        self.val = np.zeros((2, 1 << self.BITS), np.int32)
        self.rest: dict[int, int] = {}
        self.pool = np.zeros(1 << 20, np.int32)
        self.at = np.zeros(1 << 16, np.int64)
        self.len = np.zeros(1 << 16, np.int64)
        self.n_words = self.used = 0

    def _slots(self, h: np.ndarray):
        yield h >> np.uint64(64 - self.BITS)
        yield (h >> np.uint64(8)) & np.uint64((1 << self.BITS) - 1)

    def _find(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        for side, s in enumerate(self._slots(h)):
            hit = (self.key[side][s] == h) & (h != 0)
            out[hit] = self.val[side][s[hit]]
        miss = np.flatnonzero(out < 0)
        if len(miss) and self.rest:
            out[miss] = [self.rest.get(x, -1) for x in h[miss].tolist()]
        return out

    def _learn(self, h: np.ndarray, word: list[str]) -> None:
        text = " ".join(word)
        ids = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)
        end = np.flatnonzero(self.ends_word[ids]) + 1
        if len(end) != len(word):        # never for plain words; stay exact all the same
            each = [self.tok.encode(w, add_special_tokens=False).ids for w in word]
            ids = np.array([i for e in each for i in e], np.int32)
            end = np.cumsum([len(e) for e in each])
        start = np.concatenate([[0], end[:-1]])
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n_words + len(word) > len(self.at):
            self.at, self.len = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.len))
        self.pool[self.used:self.used + len(ids)] = ids
        number = np.arange(self.n_words, self.n_words + len(word))
        self.at[number], self.len[number] = self.used + start, end - start
        self.used += len(ids)
        self.n_words += len(word)
        left = np.arange(len(h))
        for side, s in enumerate(self._slots(h)):
            s = s[left]
            free = self.key[side][s] == 0
            _, first = np.unique(s, return_index=True)
            take = np.zeros(len(left), bool)
            take[first] = True
            take &= free
            self.key[side][s[take]] = h[left[take]]
            self.val[side][s[take]] = number[left[take]]
            left = left[~take]
            if side == 0:
                continue
        for i in left.tolist():
            self.rest[int(h[i])] = int(number[i])

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids with the end token after each row, offsets)."""
        if self.n_words > MAX_WORDS:
            self._forget()
        rows = len(off) - 1
        cls, low, bad = plain_classes(data, off)
        n = len(data)
        first = np.ones(n, bool)
        if n:
            first[1:] = (cls[1:] != cls[:-1]) | (cls[1:] == DIGIT)
            first[off[:-1][off[:-1] < n]] = True
        edge = np.flatnonzero(first)
        stop = np.append(edge[1:], n)
        keep = cls[edge] != SPACE
        if bad.any():
            keep &= ~bad[rows_of(off, edge)]
        s, e = edge[keep], stop[keep]
        h = self.hasher(low, s, e, self.seeds)
        word = self._find(h)
        miss = np.flatnonzero(word < 0)
        if len(miss):
            new, ix = np.unique(h[miss], return_index=True)
            raw = low.tobytes()
            self._learn(new, [raw[s[i]:e[i]].decode() for i in miss[ix].tolist()])
            word[miss] = self._find(h[miss])
        length = self.len[word]
        row = rows_of(off, s)
        count = np.bincount(row, length, rows).astype(np.int64)
        slow = {}
        for r in np.flatnonzero(bad).tolist():
            text = data[off[r]:off[r + 1]].tobytes().decode()
            slow[r] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)
            count[r] = len(slow[r])
        out_off = np.concatenate([[0], np.cumsum(count + 1)])
        out = np.full(out_off[-1], END_ID, np.int32)
        total = int(length.sum())
        if total:
            begin = np.cumsum(length) - length
            within = np.arange(total) - np.repeat(begin, length)
            per_row = np.bincount(row, minlength=rows)
            base = np.cumsum(np.bincount(row, length, rows).astype(np.int64)) - np.bincount(row, length, rows).astype(np.int64)
            place = begin - np.repeat(base, per_row) + np.repeat(out_off[:-1], per_row)
            out[np.repeat(place, length) + within] = self.pool[np.repeat(self.at[word], length) + within]
        for r, ids in slow.items():
            out[out_off[r]:out_off[r] + len(ids)] = ids
        return out, out_off


def cut_points(ids: np.ndarray, ends: np.ndarray, penalty: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, penalty) of the cut points of a buffer whose documents end at ``ends``."""
    pen = penalty[ids]
    pen[ends - 1] = 0
    pos = np.flatnonzero(pen >= 0) + 1
    pen = pen[pos - 1]
    step = min(STEP, max(1, size // 4))
    gap = np.diff(np.concatenate([[0], pos]))
    extra = np.concatenate([np.zeros(0, np.int64), *[np.arange(pos[i] - gap[i] + step, pos[i], step)
                                                     for i in np.flatnonzero(gap > step)]])
    every = np.concatenate([pos, extra])
    order = np.argsort(every, kind="stable")
    return every[order], np.concatenate([pen, np.full(len(extra), INSIDE_PENALTY)])[order]


def best_cuts(pos: np.ndarray, pen: np.ndarray, size: int) -> list[int]:
    """Window ends of the cheapest cut from 0 to the last point, by a monotone queue."""
    xs, ps = [0, *pos.tolist()], [0, *pen.tolist()]
    f, back = [0] * len(xs), [0] * len(xs)
    q: deque[tuple[int, int]] = deque([(0, 0)])         # (f + x, point), values increasing
    for j in range(1, len(xs)):
        x = xs[j]
        while xs[q[0][1]] < x - size:
            q.popleft()
        best, back[j] = q[0]
        f[j] = best + size - x + ps[j]
        v = f[j] + x
        while q and q[-1][0] >= v:
            q.pop()
        q.append((v, j))
    out, j = [], len(xs) - 1
    while j:
        out.append(xs[j])
        j = back[j]
    return out[::-1]


def power_cuts(length: int) -> list[int]:
    """Lengths of powers of two, greatest first, that sum to ``length``."""
    return [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]


class Packer:
    """Buffers documents of one task and emits the pieces of finished windows."""

    def __init__(self, penalty: np.ndarray, size: int, first_id: int) -> None:
        self.penalty, self.size, self.next_id = penalty, size, first_id
        self.docs: list = []          # key, ids still to pack, ids already packed, all ids
        self.held = 0

    def add(self, key, ids: np.ndarray) -> None:
        self.docs.append((key, ids, 0, len(ids)))
        self.held += len(ids)

    def flush(self, final: bool) -> list[tuple]:
        """Pieces (key, start, length, ids, doc tokens, sequence, offset)."""
        if not self.docs:
            return []
        ids = np.concatenate([d[1] for d in self.docs])
        ends = np.cumsum([len(d[1]) for d in self.docs])
        cuts = best_cuts(*cut_points(ids, ends, self.penalty, self.size), self.size)
        if final:
            last = cuts[-2] if len(cuts) > 1 else 0
            if cuts[-1] - last < self.size:
                cuts = cuts[:-1] + list(last + np.cumsum(power_cuts(int(cuts[-1] - last))))
        else:
            cuts = [c for c in cuts if c <= len(ids) - 8 * self.size]
        out, d, at = [], 0, 0                           # at: packed ids of the buffer
        begin = 0
        for c in cuts:
            window = at
            while at < c:
                key, own, done, total = self.docs[d]
                take = min(c, int(ends[d])) - at
                lo = at - begin
                out.append((key, done + lo, take, own[lo:lo + take], total, self.next_id, at - window))
                at += take
                if at == ends[d]:
                    begin, d = int(ends[d]), d + 1
            self.next_id += 1
        rest = self.docs[d:]
        if rest and at > begin:
            key, own, done, total = rest[0]
            rest[0] = (key, own[at - begin:], done + at - begin, total)
        self.docs, self.held = rest, len(ids) - at
        return out


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces (key, start, length, ids as little-endian unsigned 32-bit bytes, doc_tokens, sequence_id, offset).

    ``vocabulary``: path of a tokenizers file; its content is broadcast (a few MB)."""
    if size < 2 or size & (size - 1):
        raise ValueError("size must be a power of two")
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        enc = Encoder(shared.value)
        context = TaskContext.get()
        packer = Packer(enc.penalty, size, (context.partitionId() if context else 0) << 40)
        key_type = None

        def out(pieces):
            for lo in range(0, len(pieces), 256):
                p = pieces[lo:lo + 256]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[0] for x in p], key_type), pa.array([x[1] for x in p], pa.int64()),
                     pa.array([x[2] for x in p], pa.int64()),
                     pa.array([x[3].astype("<u4").tobytes() for x in p], pa.binary()),
                     pa.array([x[4] for x in p], pa.int64()), pa.array([x[5] for x in p], pa.int64()),
                     pa.array([x[6] for x in p], pa.int64())],
                    names=[key, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for b in batches:
            key_type = b.column(0).type
            keys = b.column(0).to_pylist()
            data, off = text_arrays(b.column(1))
            for lo, hi in row_chunks(off):
                ids, cut = enc.encode(data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo])
                for i in range(hi - lo):
                    packer.add(keys[lo + i], ids[cut[i]:cut[i + 1]])
                if packer.held >= FLUSH:
                    yield from out(packer.flush(False))
        if packer.docs:
            yield from out(packer.flush(True))

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(
        run, f"`{key}` {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
