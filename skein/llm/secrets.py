"""Operator 4: secret scans, fixed rules widened by a character convolutional network.

Base findings (leftmost non-overlapping per kind, offsets in code points):
``assign`` keyword assignments, ``access`` key ids, ``hex`` strings. They
always stay. Candidates of the model are all runs of ``[A-Za-z0-9+/_=-]`` that touch no base
finding, have ``MIN_RUN`` characters or more and are no plain word: they hold a digit, one of
``+/_=`` or mixed case, have ``LONG_RUN`` characters or stand behind ``:`` or ``=``. Each is
seen with its surrounding context as windows of ``WINDOW`` bytes (a long run as several that
overlap, of which the best counts) by a small
network in numpy (byte embedding, convolution, max and mean pooling, logistic
output).

The network is trained on labelled findings of all documents: the values of base findings
(an assignment's without its keyword, as candidates stand) against candidates that touch no finding, of forms (character
classes and length) that are hardly ever labelled (under ``RARE`` of the form's runs in the corpus, with 95 % confidence),
such as plain numbers. Candidates of a form that findings have stay unlabelled. Nothing is sampled: every distinct finding and
such candidate is learnt from. Words are never scored and no examples, unless the table has no such candidate: then every
distinct word is learnt from, weighted by its number and seen in one of its contexts (that of least hash). Windows are dealt
to shards by hash; each epoch a task per shard trains from the common network, and the mean of theirs is the next one, so
neither the layout of the rows nor their order matters. Each window is learnt
twice, with and without its context, so that the value alone tells, too.
Scores are calibrated on a fifth of all windows, held out by hash (Platt with a damped Newton step, kinds weighted by their
numbers in the corpus), and the threshold is the greatest up to even odds that keeps
``min_recall`` of all held-out findings. Candidates at or above it are added as ``model``.

Cases: null is the empty text (no findings); repeated rows are scanned one by
one; if the whole table has no finding, or no other run, nothing is added; findings
never cross rows; further columns are not read; very long texts and runs are scanned whole.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bytesops import SpanHash, row_chunks, rows_of, seed_table, spans, text_arrays
from skein.llm.hashfeat import Adam
from skein.llm.scratch import bound_batches, drop_saved, save

# Fixed values of the contract.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
LEAST = {"assign": 8, "access": 16, "hex": 32}
KINDS = ("assign", "access", "hex", "model")
ANCHORS = (b"password", b"passwd", b"secret", b"token", b"api")     # how a keyword begins

MIN_RUN, LONG_RUN = 8, 20
RARE = 0.05
FORM_LENGTHS = (12, 16, 24, 32, 40)     # run lengths at which a form's length class changes
LEFT, BODY, RIGHT = 24, 48, 8
WINDOW = LEFT + BODY + RIGHT
EMBED, FILTERS, WIDTH = 8, 16, 5


def _run_bytes() -> np.ndarray:
    m = np.zeros(256, bool)
    m[48:58] = m[65:91] = m[97:123] = True
    m[np.frombuffer(b"+/_=-", np.uint8)] = True
    return m


def base_findings(raw: bytes, data: np.ndarray, off: np.ndarray):
    """(row, kind, start, end, start of the value) of the base findings."""
    out = []
    low = raw.lower()
    at = []
    for word in ANCHORS:
        p = low.find(word)
        while p >= 0:
            at.append(p)
            p = low.find(word, p + 1)
    at.sort()
    pattern = re.compile(ASSIGN, re.I)
    done = -1
    for p, row in zip(at, rows_of(off, np.array(at, np.int64)).tolist(), strict=True):
        if p < done:
            continue
        m = pattern.match(raw, p, int(off[row + 1]))
        if m:
            done = m.end()
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                out.append((row, 0, m.start(), m.end(), m.start(2)))
    s, e = spans(_run_bytes()[data], off)
    long = e - s >= LEAST["access"]           # both other kinds lie within one run
    s, e = s[long], e[long]
    c = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    digits = c[e] - c[s]
    rows = rows_of(off, s)
    rules = [(1, re.compile(ACCESS), LEAST["access"]), (2, re.compile(HEX), LEAST["hex"])]
    for i in np.flatnonzero((digits > 0) | (e - s >= LEAST["access"])):
        a, b = int(s[i]), int(e[i])
        for kind, rule, least in rules:
            if b - a >= least:
                for m in rule.finditer(raw, a, b):
                    if m.end() - m.start() >= least:
                        out.append((int(rows[i]), kind, m.start(), m.end(), m.start()))
    return out


def other_runs(data: np.ndarray, off: np.ndarray, found: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, candidate, form) of the runs of 5 characters or more that touch no finding."""
    s, e = spans(_run_bytes()[data], off)
    some = e - s >= 5
    s, e = s[some], e[some]
    if found and len(s):
        edge, end = np.array(sorted((f[2], f[3]) for f in found), np.int64).T
        before = np.searchsorted(edge, e, "left") - 1                  # findings that start before the run ends
        some = (before < 0) | (np.maximum.accumulate(end)[np.maximum(before, 0)] <= s)
        s, e = s[some], e[some]

    def count(mask):
        return np.concatenate([[0], np.cumsum(mask)])

    digit, upper, lower = (count((data >= lo) & (data <= hi)) for lo, hi in ((48, 57), (65, 90), (97, 122)))
    symbol = count(np.isin(data, np.frombuffer(b"+/_=", np.uint8)))
    has = [c[e] - c[s] > 0 for c in (digit, upper, lower, symbol)]
    mixed = (upper[e] - upper[np.minimum(s + 1, e)] > 0) & has[2]
    row = off[rows_of(off, s)]
    back = np.stack([np.where(s - k >= row, data[np.maximum(s - k, 0)], 0) for k in (1, 2, 3)]) if len(s) else np.zeros((3, 0))
    sign, gap = np.isin(back, (58, 61)), np.isin(back, (32, 34, 39))
    behind = sign[0] | gap[0] & (sign[1] | gap[1] & sign[2])
    cand = (e - s >= MIN_RUN) & (has[0] | has[3] | mixed | (e - s >= LONG_RUN) | behind)
    return s, e, cand, form_of(e - s, has)


def form_of(length: np.ndarray, has: list[np.ndarray]) -> np.ndarray:
    """Number of a run's form: which character classes it holds, and its length class."""
    return np.searchsorted(FORM_LENGTHS, length, "right") * 16 + sum(h.astype(np.int64) << i for i, h in enumerate(has))


def form_of_bytes(x: bytes) -> int:
    has = [np.array([any(lo <= c <= hi for c in x)]) for lo, hi in ((48, 57), (65, 90), (97, 122))]
    return int(form_of(np.array([len(x)]), [*has, np.array([any(c in b"+/_=" for c in x)])])[0])


def windows(data: np.ndarray, off: np.ndarray, rows, s, e) -> np.ndarray:
    """Fixed windows: context before, the first ``BODY`` bytes of the run, context after these; 0 beyond the row."""
    s, e = np.asarray(s, np.int64), np.asarray(e, np.int64)
    if not len(s):
        return np.zeros((0, WINDOW), np.uint8)
    lo, hi, end = off[rows][:, None], off[np.asarray(rows) + 1][:, None], np.minimum(e, s + BODY)[:, None]
    at = s[:, None] - LEFT + np.arange(LEFT + BODY)
    right = end + np.arange(RIGHT)
    at, ok = np.concatenate([at, right], axis=1), np.concatenate([(at >= lo) & (at < end), right < hi], axis=1)
    return np.where(ok, data[np.clip(at, 0, len(data) - 1)], 0).astype(np.uint8)


def slide(s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, start, end) of the windows of each run: half a body apart, the last one up to the run's end."""
    n = np.maximum(-(-(e - s - BODY) // (BODY // 2)), 0) + 1
    run = np.repeat(np.arange(len(s)), n)
    k = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start = np.minimum(s[run] + k * (BODY // 2), np.maximum(e[run] - BODY, s[run]))
    return run, start, e[run]


def forward(p: dict, x: np.ndarray) -> tuple[np.ndarray, tuple]:
    emb = p["emb"][x]                                                    # n, window, embed
    cols = np.lib.stride_tricks.sliding_window_view(emb, WIDTH, axis=1)  # n, positions, embed, width
    cols = cols.reshape(len(x), WINDOW - WIDTH + 1, EMBED * WIDTH)
    conv = np.maximum(cols @ p["conv"] + p["cb"], 0)
    peak = conv.argmax(axis=1)
    pooled = np.concatenate([np.take_along_axis(conv, peak[:, None], 1)[:, 0], conv.mean(axis=1)], axis=1)
    return pooled @ p["out"] + p["ob"][0], (cols, conv, peak, pooled)


def train(x: np.ndarray, y: np.ndarray, epochs: int = 12, batch: int = 128, seed: int = 7, weight: np.ndarray | None = None,
          start: dict | None = None) -> dict:
    """The network fitted by Adam on weighted logistic loss (balanced without weights), from ``start`` on if there is one."""
    rng = np.random.default_rng(seed)
    p = {"emb": rng.normal(0, 0.3, (256, EMBED)), "conv": rng.normal(0, 0.2, (EMBED * WIDTH, FILTERS)),
         "cb": np.zeros(FILTERS), "out": rng.normal(0, 0.2, 2 * FILTERS), "ob": np.zeros(1)}
    if start is not None:
        p = {k: v.copy() for k, v in start.items()}
    if weight is None:
        weight = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    opt = Adam(p, 0.01)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            i = order[lo:lo + batch]
            z, (cols, conv, peak, pooled) = forward(p, x[i])
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)
            gp = g[:, None] * p["out"]
            gc = np.repeat(gp[:, None, FILTERS:] / conv.shape[1], conv.shape[1], axis=1)
            np.put_along_axis(gc, peak[:, None], np.take_along_axis(gc, peak[:, None], 1) + gp[:, None, :FILTERS], 1)
            gc = gc * (conv > 0)
            gcol = (gc @ p["conv"].T).reshape(len(i), conv.shape[1], EMBED, WIDTH)
            ge = np.zeros((len(i), WINDOW, EMBED))
            for k in range(WIDTH):
                ge[:, k:k + conv.shape[1]] += gcol[..., k]
            gemb = np.zeros((256, EMBED))
            np.add.at(gemb, x[i].ravel(), ge.reshape(-1, EMBED))
            opt.step(p, {"emb": gemb, "conv": np.einsum("npc,npf->cf", cols, gc), "cb": gc.sum(axis=(0, 1)),
                         "out": pooled.T @ g, "ob": np.array([g.sum()])})
    return p


def platt(z: np.ndarray, y: np.ndarray, weight: np.ndarray, count: np.ndarray | None = None, steps: int = 100) -> tuple[float, float]:
    """Slope and shift that calibrate logits on held-out windows (each logit stands for ``count`` of them): weighted logistic
    regression with smoothed targets and a prior on the slope; Newton steps are halved until the loss falls, so it converges on
    separated classes too."""
    n = np.ones(len(z)) if count is None else count.astype(float)
    t = np.where(y == 1, ((n * y).sum() + 1) / ((n * y).sum() + 2), 1 / ((n * (1 - y)).sum() + 2))
    scale = max(float((n * np.abs(z)).sum() / n.sum()), 1e-6)
    x = z / scale
    w = weight * n / (weight * n).sum() * n.sum()

    def loss(a, b):
        q = a * x + b
        return (w * (np.logaddexp(0, q) - t * q)).sum() + 0.5 * (0.1 * (a - 1) ** 2 + 0.001 * b * b)

    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = w * q * (1 - q)
        ga, gb = (w * (q - t) * x).sum() + 0.1 * (a - 1), (w * (q - t)).sum() + 0.001 * b
        haa, hab, hbb = (h * x * x).sum() + 0.1, (h * x).sum(), h.sum() + 0.001
        det = haa * hbb - hab * hab
        da, db, step = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det, 1.0
        while step > 1e-6 and loss(a - step * da, b - step * db) > loss(a, b):
            step /= 2
        a, b = a - step * da, b - step * db
        if step * (abs(da) + abs(db)) < 1e-9:
            break
    return float(max(a, 0.0) / scale), float(b)


class Distinct:
    """Windows by their identity with the number of runs they stand for; of equal ones that of the least hash stays.
    What is held is bounded: ``drain`` gives it away, and the rest of the grouping is Spark's."""

    def __init__(self, limit: int = 1 << 16) -> None:
        self.limit, self.parts, self.rows = limit, [], 0

    def add(self, kind: int, v: np.ndarray, h: np.ndarray, form: np.ndarray, data: np.ndarray, off: np.ndarray, s: np.ndarray,
            e: np.ndarray) -> None:
        """Runs [s, e) with identities and hashes; the kind takes the two low bits of the identity."""
        if len(v):
            v = v & ~np.uint64(3) | np.uint64(kind)
            i, n = self._first(v, h, np.ones(len(v), np.int64))
            self.parts.append((v[i], h[i], form[i], n, windows(data, off, rows_of(off, s[i]), s[i], e[i])))
            self.rows += len(i)

    @staticmethod
    def _first(v, h, n):
        order = np.lexsort((h, v))
        start = np.flatnonzero(np.append(True, v[order][1:] != v[order][:-1]))
        return order[start], np.add.reduceat(n[order], start)

    def drain(self, end: bool = False):
        import pyarrow as pa
        if self.rows > 2 * self.limit or end and self.rows:
            v, h, form, n, w = (np.concatenate(c) for c in zip(*self.parts, strict=True))
            i, n = self._first(v, h, n)
            self.parts, self.rows = [(v[i], h[i], form[i], n, w[i])], len(i)
            if end or self.rows > self.limit:
                body = pa.FixedSizeBinaryArray.from_buffers(pa.binary(WINDOW), len(i), [None, pa.py_buffer(w[i].tobytes())])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(v[i].view(np.int64)), pa.array((h[i] >> np.uint64(1)).view(np.int64)), pa.array(form[i].astype(np.int32)),
                     pa.array(n), body.cast(pa.binary())], names=["v", "h", "form", "n", "w"])
                self.parts, self.rows = [], 0


WORD, FINDING, CANDIDATE = range(3)       # kinds of runs that the training looks at
FORMS = (len(FORM_LENGTHS) + 1) * 16
PARAMS = {"emb": (256, EMBED), "conv": (EMBED * WIDTH, FILTERS), "cb": (FILTERS,), "out": (2 * FILTERS,), "ob": (1,)}
STEPS, EPOCHS = 1500, (2, 12)             # steps of a shard's training, and the epochs they make at least and at most
FIXED = float(1 << 24)                    # sums of fixed-point numbers do not depend on their order
GRID = 256                                # steps of the logit that the calibration tells apart


def labelled_windows(docs: DataFrame, text: str = "text", words: bool = False) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """(windows, runs seen by kind and form, rare forms) of all documents. Windows (v, kind, n, w): every distinct finding and every
    distinct candidate of a rare form with its context; with ``words`` every distinct word (in one context), too. n is its number."""
    bound_batches(docs.sparkSession)

    def label(batches):
        kept, hasher, table = Distinct(), SpanHash(), seed_table()
        for b in batches:
            all_data, all_off = text_arrays(b.column(0))
            for lo, hi in row_chunks(all_off):
                data, off = all_data[all_off[lo]:all_off[hi]], all_off[lo:hi + 1] - all_off[lo]
                raw = data.tobytes()
                found = base_findings(raw, data, off)
                s, e, cand, form = other_runs(data, off, found)
                values = np.array([(f[4], f[3]) for f in found], np.int64).reshape(-1, 2)
                forms = np.array([form_of_bytes(raw[a:z]) for a, z in values], np.int64)
                sums = hasher.sums(data, table)
                for k, a, z, c in ((FINDING, values[:, 0], values[:, 1], forms), (CANDIDATE, s[cand], e[cand], form[cand]),
                                   (WORD, s[~cand & words], e[~cand & words], form[~cand & words])):
                    row, value = rows_of(off, a), hasher.of(sums, a, z)
                    h = hasher.of(sums, np.maximum(a - LEFT, off[row]), np.minimum(z + RIGHT, off[row + 1]))
                    h = h * np.uint64(3) ^ value                                                   # runs may share a context
                    kept.add(k, value if k == WORD else h, h, c, data, off, a, z)
                yield from kept.drain()
        yield from kept.drain(end=True)

    per = save(docs.select(F.col(text).cast("string").alias("t")).mapInArrow(label, "v long, h long, form int, n long, w binary"), "secrets")
    kind = F.col("v").bitwiseAND(F.lit(3)).cast("int")
    seen = np.zeros((3, FORMS))
    for r in per.groupBy(kind.alias("kind"), "form").agg(F.sum("n").alias("n")).collect():          # 3 x FORMS rows at most
        seen[r["kind"], r["form"]] = r["n"]
    # three more findings (the rule of three): a form must be seen often enough to tell
    rare = seen[FINDING] + 3 < RARE * (seen[FINDING] + seen[CANDIDATE] + 3)
    out = save(per.filter((kind != CANDIDATE) | F.col("form").isin(np.flatnonzero(rare).tolist()))
               .groupBy("v").agg(F.sum("n").alias("n"), F.min_by("w", "h").alias("w")).withColumn("kind", kind), "secrets-windows")
    drop_saved(per)
    return out, seen, rare


def in_shards(rows: DataFrame, number: dict[int, float], size: int) -> tuple[DataFrame, int]:
    """(shards, their number): the windows (v, kind, n, w) dealt by hash to shards of about ``size``. A kind that is too rare to fill a
    quarter of each shard is dealt to several of them, to all at most. ``weight`` makes either kind half of the loss, words by log(1 + n)."""
    spark, total = rows.sparkSession, sum(n for n, _ in number.values())
    shards = max(-(-total // size), 1)
    copies = {k: int(min(max(-(-shards * (size // 4) // n), 1), shards)) for k, (n, _) in number.items()}
    all_copies = sum(n * copies[k] for k, (n, _) in number.items())
    table = spark.createDataFrame([(k, copies[k], 0.5 / (mass * copies[k]) * all_copies) for k, (_, mass) in number.items()],
                                  "kind int, copies int, unit double")
    dealt = rows.join(F.broadcast(table), "kind") \
        .withColumn("weight", F.col("unit") * F.when(F.col("kind") == WORD, F.log1p("n")).otherwise(1.0)) \
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("copies") - 1))) \
        .withColumn("shard", F.pmod(F.xxhash64("v", F.lit("shard")) + F.col("j"), F.lit(shards)))
    out = dealt.groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("v", "kind", "weight", "w"))).alias("rows"))
    return save(out.repartition(shards), "secrets-shards"), shards


def learn(shards: DataFrame, start: dict | None, epochs: int, seed: int) -> dict:
    """The mean of the networks that the shards make of ``start``, each in its own task."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            for i in range(b.num_rows):
                rows = b.column(0).slice(i, 1).flatten()
                x = np.frombuffer(b"".join(rows.field("w").to_pylist()), np.uint8).reshape(-1, WINDOW)
                y = (rows.field("kind").to_numpy() == FINDING).astype(int)
                bare = x.copy()                                  # once more without context: the value alone must tell, too
                bare[:, :LEFT] = bare[:, LEFT + BODY:] = 0
                p = train(np.concatenate([x, bare]), np.concatenate([y] * 2), epochs, seed=seed, start=start,
                          weight=np.concatenate([rows.field("weight").to_numpy()] * 2))
                flat = np.concatenate([p[k].ravel() for k in PARAMS])
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(np.rint(flat * FIXED).astype(np.int64)),
                                                  pa.array(np.ones(len(flat), np.int64))], names=["i", "q", "n"])

    got = shards.select("rows").mapInArrow(run, "i int, q long, n long").groupBy("i").agg(F.sum("q").alias("q"), F.sum("n").alias("n")).collect()
    flat = np.array([r["q"] / FIXED / r["n"] for r in sorted(got, key=lambda r: r["i"])])         # one number per parameter
    ends = np.cumsum([np.prod(s) for s in PARAMS.values()])
    return {k: part.reshape(PARAMS[k]) for k, part in zip(PARAMS, np.split(flat, ends[:-1]), strict=True)}


def logit_counts(rows: DataFrame, p: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kind, logit, number) of all windows, the logits rounded down to a grid, which bounds what comes to the driver."""

    def run(batches):
        import pyarrow as pa
        for b in batches:
            x = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(-1, WINDOW)
            z = np.concatenate([np.zeros(0), *[forward(p, x[i:i + 512])[0] for i in range(0, len(x), 512)]])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.floor(np.clip(z, -64, 64) * GRID).astype(np.int32))], names=["kind", "q"])

    got = rows.select("kind", "w").mapInArrow(run, "kind int, q int").groupBy("kind", "q").agg(F.count(F.lit(1)).alias("n")) \
        .orderBy("q", "kind").collect()
    return tuple(np.array(c) for c in zip(*[(r["kind"], r["q"] / GRID, r["n"]) for r in got], strict=True))


def fit(docs: DataFrame, text: str = "text", max_windows: int = 1 << 15, min_recall: float = 0.95) -> dict | None:
    """Train on the findings and other runs of all documents; None if there is no finding or no other run to learn from.

    ``max_windows`` bounds what one task learns from at a time, not what is learnt from: more windows make more shards, whose
    networks are averaged after each epoch."""
    rows, seen, rare = labelled_windows(docs, text)
    if seen[FINDING].any() and not seen[CANDIDATE][rare].any():     # nothing of the kind that is scored: words tell what is no secret
        drop_saved(rows)
        rows, seen, rare = labelled_windows(docs, text, words=True)
    held = F.pmod(F.xxhash64("v", F.lit("held")), F.lit(5)) == 0
    by = {False: {}, True: {}}
    for r in rows.groupBy("kind", held.alias("held")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.rint(F.log1p("n") * F.lit(FIXED)).cast("long")).alias("words")) \
            .orderBy("kind", "held").collect():                      # six rows
        by[r["held"]][r["kind"]] = (r["n"], r["words"] / FIXED if r["kind"] == WORD else float(r["n"]))
    number = {k: tuple(map(sum, zip(*[by[h][k] for h in by if k in by[h]], strict=True))) for k in range(3) if any(k in by[h] for h in by)}
    if FINDING not in number or len(number) < 2:
        drop_saved(rows)
        return None
    if all(FINDING in by[h] and len(by[h]) > 1 for h in by):
        number, learnt, use = by[False], rows.filter(~held), rows.filter(held)
    else:
        learnt = use = rows
    shards, n = in_shards(learnt, number, max(max_windows, 4))
    per_epoch = max(2 * sum(c for c, _ in number.values()) // (128 * n), 1)
    epochs = int(np.clip(-(-STEPS // per_epoch), *EPOCHS))
    p = None
    for k in range(epochs if n > 1 else 1):
        p = learn(shards, p, 1 if n > 1 else epochs, 7 + k)
    drop_saved(shards)
    kind, z, count = logit_counts(use, p)
    drop_saved(rows)
    y = (kind == FINDING).astype(int)
    runs = {FINDING: seen[FINDING].sum(), CANDIDATE: seen[CANDIDATE][rare].sum(), WORD: 1.0}
    weight = np.array([max(runs[k] / max(count[kind == k].sum(), 1), 1e-3) for k in kind])
    a, b = platt(z, y, weight, count)
    least = np.searchsorted(np.cumsum(count[y == 1]), np.floor((1 - min_recall) * count[y == 1].sum()), "right")
    threshold = min(0.5, float(1 / (1 + np.exp(-np.clip(a * z[y == 1][least] + b, -30, 30)))))
    return {"p": p, "platt": (a, b), "threshold": threshold, "learnt": {k: int(c) for k, (c, _) in number.items()}}


def probability(model: dict, x: np.ndarray) -> np.ndarray:
    a, b = model["platt"]
    out = [forward(model["p"], x[i:i + 512])[0] for i in range(0, len(x), 512)]
    z = np.concatenate([np.zeros(0), *out])
    return 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))


def scan_texts(model: dict | None, col) -> tuple[dict[int, list], np.ndarray]:
    """Findings by row, (start, kind, end, byte start, byte end) in order, and the best model score per row."""
    all_data, all_off = text_arrays(col)
    out: dict[int, list] = {}
    score = np.zeros(len(all_off) - 1)
    for lo, hi in row_chunks(all_off):
        data, off = all_data[all_off[lo]:all_off[hi]], all_off[lo:hi + 1] - all_off[lo]
        base = base_findings(data.tobytes(), data, off)
        found = [f[:4] for f in base]
        if model is not None:
            s, e, cand, _ = other_runs(data, off, base)
            s, e = s[cand], e[cand]
            run, a, z = slide(s, e)
            prob = np.zeros(len(s))
            for i in range(0, len(run), 4096):
                part = slice(i, i + 4096)
                np.maximum.at(prob, run[part], probability(model, windows(data, off, rows_of(off, a[part]), a[part], z[part])))
            rows = rows_of(off, s)
            np.maximum.at(score, lo + rows, prob)
            found += [(int(rows[i]), 3, int(s[i]), int(e[i])) for i in np.flatnonzero(prob >= model["threshold"])]
        for r in {f[0] for f in found}:
            points = np.concatenate([[0], np.cumsum((data[off[r]:off[r + 1]] & 0xC0) != 0x80)])
            out[lo + r] = sorted((int(points[a - off[r]]), k, int(points[z - off[r]]), a - int(off[r]), z - int(off[r]))
                                 for q, k, a, z in found if q == r)
    return out, score


def scan(docs: DataFrame, model: dict | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, findings array<struct<kind, start, end>> in order, score), one row per input row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)       # a few thousand numbers
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        item = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            by_row, score = scan_texts(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([[(KINDS[k], a, z) for a, k, z, _, _ in by_row.get(i, [])]
                                        for i in range(b.num_rows)], item), pa.array(score)],
                names=[key, "findings", "score"])

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(
        run, f"`{key}` {kind}, findings array<struct<kind: string, start: bigint, end: bigint>>, score double")


def redact(docs: DataFrame, model: dict | None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """The input rows with every finding (overlapping ones merged) replaced by ``mark``; texts without one unchanged."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa
        for b in batches:
            by_row, _ = scan_texts(shared.value, b.column(at))
            if by_row:
                texts = b.column(at).to_pylist()
                for r, found in by_row.items():
                    raw, out, done = texts[r].encode(), [], 0
                    for a, z in sorted((f[3], f[4]) for f in found):
                        if a >= done:
                            out += [raw[done:a], mark.encode()]
                        done = max(done, z)
                    texts[r] = b"".join([*out, raw[done:]]).decode()
                cols = list(b.columns)
                cols[at] = pa.array(texts, b.schema.field(at).type)
                b = pa.RecordBatch.from_arrays(cols, names=b.schema.names)
            yield b

    return docs.mapInArrow(run, docs.schema)
