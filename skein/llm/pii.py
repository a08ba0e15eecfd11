"""Operator 12: personal data, fixed rules widened by bootstrapped contextual extraction.

Base findings (leftmost non-overlapping per kind, offsets in code points) are
``email``, ``ip``, ``card`` and ``phone``; they always stay. They also seed the bootstrap:

* ``occurrences`` reads every text once. It emits the base findings and the
  *slots*: the findings themselves, and other places that look like an
  identifier (words with digits or an ``@``, joined by single spaces, that touch
  no finding, with 5 digits or an ``@`` between other characters, ``MOST`` bytes
  at most). Each slot has two lexical patterns: the two words before it, and the
  word before and the word after it (lower case, digits as 0).
* ``learn`` scores the graph of patterns and distinct instances (slot texts without
  punctuation) in Spark, round by round. A pattern's confidence is the Wilson lower bound
  (``z``) of the share of its instances that are reliable. It is accepted if that is at
  least ``min_confidence`` and above the share over the whole graph, so contexts that say
  nothing are not taken for patterns. An unseen instance becomes reliable by noisy-or over its accepted
  patterns, which may lift further patterns in the next round. It ends when the
  accepted set does not change, after ``max_rounds`` at the latest.
* ``find`` adds the unseen slots of accepted patterns as ``context``.

The graph has a row for each distinct (pattern, instance), summed before any shuffle;
texts are read once and never shuffled, and accepted patterns meet the slots by a join.

Cases: null is the empty text (no findings); repeated rows are scanned one by
one, their slots are one instance; findings never cross rows; a table without
findings has no patterns, so nothing is added; the empty table gives no rows;
further columns are not read; very long runs of any characters take linear time.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.bytesops import row_chunks, rows_of, spans, text_arrays
from skein.llm.scratch import bound_batches, drop_saved, save

KINDS = ("email", "ip", "card", "phone", "context")
SPAN = "struct<kind: string, start: bigint, end: bigint>"
SLOT = "struct<start: bigint, end: bigint, value: string, seed: boolean, patterns: array<string>>"

MOST = 40                  # bytes of a slot
LEAST_DIGITS = 5
BEFORE, AFTER = 64, 32     # bytes of context that are looked at


def _class(ranges: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[b for b in range(128) if re.match(f"[{ranges}]", chr(b))]] = True
    return m


# Fixed values of the contract: character classes of the rules.
DIGIT, LOCAL, LABEL = _class("0-9"), _class("A-Za-z0-9._%+-"), _class("A-Za-z0-9-")
PHONE = _class(r"\x20().0-9-")
WHITE = _class(r"\x20\x09-\x0D")


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = d - 48
        if i % 2:
            x = x * 2 - 9 if x > 4 else x * 2
        total += x
    return total % 10 == 0


def _chains(s: np.ndarray, e: np.ndarray, row: np.ndarray, data: np.ndarray, joint: bytes):
    """Runs joined by one byte of ``joint``: (first run of each chain, last run of each chain, chain of each run)."""
    n = len(s)
    link = np.zeros(n, bool)
    if n > 1:
        near = (s[1:] == e[:-1] + 1) & (row[1:] == row[:-1])
        link[1:] = near & np.isin(data[np.minimum(e[:-1], len(data) - 1)], np.frombuffer(joint, np.uint8))
    first = np.flatnonzero(~link)
    last = np.append(first[1:], n) - 1 if n else first
    return first, last, np.cumsum(~link) - 1


def base_findings(raw: bytes, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base findings of all rows in bytes, by start, then kind."""
    out = []
    s, e = spans(DIGIT[data], off)
    row = rows_of(off, s)
    # ip: four numbers joined by dots; chains are used up from the left
    first, last, chain = _chains(s, e, row, data, b".")
    i = np.arange(len(s))
    place = i - first[chain] if len(s) else i
    for k in i[(place % 4 == 0) & (i + 3 <= last[chain])] if len(s) else []:
        parts = [raw[s[j]:e[j]].lstrip(b"0") for j in range(k, k + 4)]
        if all(len(p) <= 3 and int(p or b"0") <= 255 for p in parts):
            out.append((int(s[k]), 1, int(e[k + 3])))
    # card: digits joined by single spaces and hyphens, whole chains
    first, last, chain = _chains(s, e, row, data, b" -")
    if len(s):
        size = np.add.reduceat(e - s, first)
        for a, z in zip(first[(size >= 12) & (size <= 19)], last[(size >= 12) & (size <= 19)], strict=True):
            if luhn(b"".join(raw[s[j]:e[j]] for j in range(a, z + 1))):
                out.append((int(s[a]), 2, int(e[z])))
    # phone: a plus, a digit, then the class run up to its last digit
    plus = np.flatnonzero(data == 43)
    plus = plus[plus + 1 < len(data)]
    plus = plus[DIGIT[data[plus + 1]]]
    if len(plus) and len(s):
        cs, ce = spans(PHONE[data], off)
        at = np.searchsorted(cs, plus + 1, "right") - 1
        ok = (rows_of(off, plus) == rows_of(off, plus + 1))
        end = ce[np.maximum(at, 0)]
        j = np.searchsorted(s, end, "left") - 1                        # the last digits before the end of the class run
        end = np.minimum(e[np.maximum(j, 0)], end)
        count = np.concatenate([[0], np.cumsum(DIGIT[data])])
        for p, z in zip(plus[ok & (end >= plus + 4)].tolist(), end[ok & (end >= plus + 4)].tolist(), strict=True):
            if 9 <= count[z] - count[p] <= 15:
                out.append((p, 3, z))
    # email: from each @ back over the local run, on over labels joined by dots
    ats = np.flatnonzero(data == 64)
    if len(ats):
        ls, le = spans(LOCAL[data], off)
        ds, de = spans(LABEL[data], off)
        _, last, chain = _chains(ds, de, rows_of(off, ds), data, b".")
        arow, done = rows_of(off, ats), 0
        left = np.searchsorted(le, ats, "left")
        right = np.searchsorted(ds, ats + 1, "left")
        for p, r, a, b in zip(ats.tolist(), arow.tolist(), left.tolist(), right.tolist(), strict=True):
            if a == len(le) or le[a] != p or p == off[r] or b == len(ds) or ds[b] != p + 1 or p + 1 >= off[r + 1]:
                continue
            start, z = max(int(ls[a]), done), last[chain[b]]
            if start < p and z > b:
                done = int(de[z])
                out.append((start, 0, done))
    return sorted(out)


def _words_around(raw: bytes, lo: int, hi: int, a: int, z: int) -> list[str]:
    """The two patterns of the slot [a, z) in the row [lo, hi)."""
    def plain(x: bytes) -> list[str]:
        return re.sub("[0-9]", "0", x.decode("utf-8", "ignore").lower()).split()

    before = ["^", "^", *plain(raw[max(lo, a - BEFORE):a])][-2:]
    after = [*plain(raw[z:min(hi, z + AFTER)]), "$"][0]
    return [f"{before[0]} {before[1]} _", f"{before[1]} _ {after}"]


def slots(raw: bytes, data: np.ndarray, off: np.ndarray, found: list[tuple[int, int, int]]) -> list[tuple[int, int, bool]]:
    """(start, end, seed): the findings, and other places that look like an identifier."""
    out = [(a, z, True) for a, _, z in found]
    marks = np.flatnonzero(DIGIT[data] | (data == 64))
    if not len(marks):
        return out
    white = np.flatnonzero(WHITE[data])
    row = rows_of(off, marks)
    k = np.searchsorted(white, marks)
    ws = np.maximum(np.append(-1, white)[k] + 1, off[row])
    we = np.minimum(np.append(white, len(data))[k], off[row + 1])
    ws, pick = np.unique(ws, return_index=True)
    we, row = we[pick], row[pick]
    if found:                                                          # words that touch a finding are out
        starts = np.array([f[0] for f in found])
        reach = np.maximum.accumulate(np.array([f[2] for f in found]))
        before = np.searchsorted(starts, we, "left") - 1
        free = (before < 0) | (reach[np.maximum(before, 0)] <= ws)
        ws, we, row = ws[free], we[free], row[free]
    first, last, _ = _chains(ws, we, row, data, b" ")
    count = np.concatenate([[0], np.cumsum(DIGIT[data])])
    at = np.concatenate([[0], np.cumsum(data == 64)])
    a, z = ws[first], we[last]
    some = (z - a <= MOST + 8) & ((count[z] - count[a] >= LEAST_DIGITS) | (at[z] > at[a]))
    for x, y in zip(a[some].tolist(), z[some].tolist(), strict=True):
        piece = raw[x:y]
        left = len(piece) - len(piece.lstrip(_MARKS))
        piece = piece.strip(_MARKS)
        digits = sum(48 <= c <= 57 for c in piece)
        if len(piece) <= MOST and (digits >= LEAST_DIGITS or b"@" in piece[1:-1]):
            out.append((x + left, x + left + len(piece), False))
    return out


_MARKS = bytes(c for c in range(33, 127) if not chr(c).isalnum())


def occurrences(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(rid, key, base, slots) for every row, in the shared folder. ``rid`` numbers the rows."""
    bound_batches(docs.sparkSession)
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        slot = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()),
                                   ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
        at = TaskContext.get().partitionId() << 33
        for b in batches:
            all_data, all_off = text_arrays(b.column(1))
            base: list[list] = [[] for _ in range(b.num_rows)]
            places: list[list] = [[] for _ in range(b.num_rows)]
            for lo, hi in row_chunks(all_off):
                data, off = all_data[all_off[lo]:all_off[hi]], all_off[lo:hi + 1] - all_off[lo]
                raw = data.tobytes()
                found = base_findings(raw, data, off)
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                own = slots(raw, data, off, found)
                for (a, k, z), r in zip(found, rows_of(off, np.array([f[0] for f in found], np.int64)), strict=True):
                    base[lo + r].append((KINDS[k], int(point[a] - point[off[r]]), int(point[z] - point[off[r]])))
                for (a, z, seed), r in zip(own, rows_of(off, np.array([x[0] for x in own], np.int64)), strict=True):
                    value = "".join(c for c in raw[a:z].decode("utf-8", "ignore").lower() if c.isalnum() or c == "@")
                    places[lo + r].append((int(point[a] - point[off[r]]), int(point[z] - point[off[r]]), value, seed,
                                           _words_around(raw, int(off[r]), int(off[r + 1]), a, z)))
            rid = pa.array(np.arange(at, at + b.num_rows), pa.int64())
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([rid, b.column(0), pa.array(base, span), pa.array(places, slot)],
                                             names=["rid", "k", "base", "slots"])

    return save(docs.select(F.col(key).alias("k"), F.col(text).cast("string").alias("_t")).mapInArrow(
        run, f"rid bigint, k {kind}, base array<{SPAN}>, slots array<{SLOT}>"), "pii-slots")


def learn(found: DataFrame, min_confidence: float = 0.5, z: float = 3.0, max_rounds: int = 5) -> DataFrame:
    """(pattern, confidence, n, known) of the accepted patterns, from ``occurrences``."""
    pairs = found.select(F.explode("slots").alias("s")) \
        .select(F.explode("s.patterns").alias("pattern"), F.col("s.value").alias("value"), F.col("s.seed").alias("seed")) \
        .groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    pairs = save(pairs, "pii-pairs")
    seeds = pairs.filter("seed").select("value", F.lit(1.0).alias("r0")).distinct()
    graph = save(pairs.drop("seed").join(seeds, "value", "left")
                 .select("pattern", "value", F.coalesce("r0", F.lit(0.0)).alias("r0")), "pii-graph")
    drop_saved(pairs)
    ground = graph.agg(F.avg("r0").alias("p")).first()["p"] or 0.0
    share, n, zz = F.col("known") / F.col("n"), F.col("n"), z * z
    bound = (share + zz / (2 * n) - z * F.sqrt(share * (1 - share) / n + zz / (4 * n * n))) / (1 + zz / n)
    floor = F.greatest(F.lit(min_confidence), F.lit(ground))
    reliable, accepted, last = None, None, None
    for _ in range(max_rounds):
        edges = graph.withColumn("r", F.col("r0")) if reliable is None else graph.join(reliable, "value", "left") \
            .withColumn("r", F.greatest("r0", F.coalesce("rel", F.lit(0.0))))
        rated = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r"), 9).alias("known"))
        new = save(rated.withColumn("confidence", bound).filter((F.col("confidence") >= floor) & (F.col("confidence") > ground))
                   .select("pattern", "confidence", "n", "known"), "pii-accepted")
        if accepted is not None:
            drop_saved(accepted)
        accepted = new
        state = accepted.agg(F.count(F.lit(1)), F.sum(F.xxhash64("pattern").cast("decimal(20,0)"))).first()
        if state == last or state[0] == 0:
            break
        last = state
        if reliable is not None:
            drop_saved(reliable)
        reliable = save(graph.filter("r0 = 0").join(accepted, "pattern").groupBy("value")
                        .agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("rel")), "pii-reliable")
    return accepted


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(key, findings array<struct<kind, start, end>> by start, then kind), one row per input row.
    ``options`` are those of ``learn``."""
    found = occurrences(docs, key, text)
    accepted = learn(found, **options).select("pattern")
    unseen = found.select("rid", F.explode("slots").alias("s")).filter("not s.seed") \
        .select("rid", F.col("s.start").alias("start"), F.col("s.end").alias("end"), F.explode("s.patterns").alias("pattern"))
    hits = unseen.join(accepted, "pattern").select("rid", F.struct("start", "end").alias("p")).distinct() \
        .groupBy("rid").agg(F.array_sort(F.collect_list("p")).alias("hits")).withColumnRenamed("rid", "r2")
    both = found.join(hits, F.col("rid") == F.col("r2"), "left")
    more = F.transform("hits", lambda p: F.struct(F.lit("context").alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    rank = {k: i for i, k in enumerate(KINDS)}

    def place(s):
        order = F.lit(len(rank))
        for k, i in rank.items():
            order = F.when(s["kind"] == k, F.lit(i)).otherwise(order)
        return F.struct(s["start"].alias("start"), order.alias("order"), s["end"].alias("end"), s["kind"].alias("kind"))

    ordered = F.array_sort(F.transform(F.concat("base", more), place))
    spans_ = F.transform(ordered, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return both.select(F.col("k").alias(key), F.when(F.col("hits").isNull(), F.col("base")).otherwise(spans_).alias("findings"))
