"""Operator 9: toxicity by cumulative-link ordinal regression.

Severity grades 0..K-1 share one weight vector; ordered cut points tell them
apart: P(grade <= k) = sigmoid(cut_k - w.x). The output is the expected
severity, sum over k of P(grade > k), with the likeliest grade and a flag.

The labelled table says only toxic or not, so grades of its toxic documents
come from the table too: *markers* are words whose share of toxic documents is
at least ``MARKER_RATIO`` times their share of the others; a toxic document's
grade is 1, 2 or 3 by the terciles of its marker count. A table with grades of
its own is passed through ``grade``.

The model is fitted on a bounded sample (``per_class`` whole documents of each
label, a parameter) and corrected to the full class sizes; the flag's
threshold on P(grade > 0) has the best F-beta on held-out labelled documents
(one fold in five; beta 2 favours recall). Every document is scored.

Cases: null and empty texts have no features and get the intercept's severity
with flag false; labels of unknown documents, null labels and null keys are
ignored; with no or one class labelled, severity is 0 (or 1) for all; repeated
rows are scored one by one; only named columns are read.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.hashfeat import Adam, Lookup, collect_matrix, featurize, sample_labelled, select_words
from skein.llm.bytesops import SpanHash
from skein.llm.scratch import bound_batches

GRADES = 4
MARKER_RATIO = 10.0


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))


def cuts_of(p: dict[str, np.ndarray]) -> np.ndarray:
    """Ordered cut points from a first one and log gaps."""
    return np.concatenate([p["first"], p["first"] + np.cumsum(np.exp(p["gap"]))])


def fit_ordinal(m: dict, grade: np.ndarray, weight: np.ndarray, n_feat: int, n_grades: int, steps: int = 300,
                l2: float = 1e-3, rate: float = 0.05) -> dict[str, np.ndarray]:
    """Cumulative-link weights and cut points by full-batch Adam on the weighted log-likelihood."""
    p = {"w": np.zeros(n_feat), "first": np.array([1.0]), "gap": np.zeros(n_grades - 2)}
    opt, n = Adam(p, rate), len(grade)
    row, feat, val = m["row"], m["feat"], m["val"].astype(np.float64)
    weight = weight / weight.sum()
    top, low = grade < n_grades - 1, grade > 0
    for _ in range(steps):
        s = np.bincount(row, p["w"][feat] * val, n) if len(row) else np.zeros(n)
        cut = cuts_of(p)
        hi = np.where(top, sigmoid(cut[np.minimum(grade, n_grades - 2)] - s), 1.0)
        lo = np.where(low, sigmoid(cut[np.maximum(grade - 1, 0)] - s), 0.0)
        d_hi, d_lo, prob = hi * (1 - hi), lo * (1 - lo), np.maximum(hi - lo, 1e-9)
        g_s = weight * (d_hi - d_lo) / prob
        g_cut = np.bincount(np.minimum(grade, n_grades - 2)[top], (-weight * d_hi / prob)[top], n_grades - 1) + \
            np.bincount(np.maximum(grade - 1, 0)[low], (weight * d_lo / prob)[low], n_grades - 1)
        tail = np.cumsum(g_cut[::-1])[::-1]              # a gap moves every later cut
        g = {"w": np.bincount(feat, g_s[row] * val, n_feat) + l2 * p["w"] / max(n_feat, 1),
             "first": np.array([tail[0]]), "gap": tail[1:] * np.exp(p["gap"])}
        opt.step(p, g)
    return p


def scores(w: np.ndarray, row, feat, val, n: int) -> np.ndarray:
    return np.bincount(row, w[feat] * val, n) if len(row) else np.zeros(n)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text",
        per_class: int = 4000, n_words: int = 512, beta: float = 2.0, grade=None) -> dict:
    """Returns {keys, w, cuts, threshold}. ``grade``: None, or a function of the
    labelled matrix giving int grades 0..GRADES-1."""
    sample, sizes = sample_labelled(docs, labels, F.when(F.col(label) > 0, 1).when(F.col(label) == 0, 0),
                                    per_class, key, text)
    if len(sizes) < 2:
        only = float(max(sizes, default=0))
        return {"keys": np.zeros(0, np.uint64), "w": np.zeros(1), "cuts": np.array([-40.0 if only else 40.0]),
                "threshold": 0.5}
    sample = sample.persist()                  # bounded by per_class
    keys = select_words(sample, 2, n_words)
    m = collect_matrix(sample, keys)
    sample.unpersist()
    n, n_feat, y = len(m["y"]), max(len(keys), 1), m["y"].astype(np.int64)
    if grade is None:
        df = np.stack([np.bincount(m["feat"][y[m["row"]] == c], minlength=n_feat) / max((y == c).sum(), 1)
                       for c in (0, 1)])
        marker = df[1] >= MARKER_RATIO * np.maximum(df[0], 1 / max((y == 0).sum(), 1))
        count = np.bincount(m["row"], np.expm1(m["val"]) * marker[m["feat"]], n).round()
        g = np.zeros(n, np.int64)
        tox = y == 1
        if tox.any():
            thirds = np.quantile(count[tox], [1 / 3, 2 / 3])
            g[tox] = 1 + (count[tox] > thirds[0]) + (count[tox] > thirds[1])
    else:
        g = grade(m)
    true = np.array([sizes.get(c, 0) for c in (0, 1)], float)
    got = np.array([max((y == c).sum(), 1) for c in (0, 1)], float)
    weight = (true / got)[y]
    fold = np.array([hash_fold(k) for k in m["k"]])
    held = fold == 0

    def part(mask):
        pos = np.cumsum(mask) - 1
        e = mask[m["row"]]
        return {"row": pos[m["row"][e]], "feat": m["feat"][e], "val": m["val"][e]}

    p = fit_ordinal(part(~held), g[~held], weight[~held], n_feat, GRADES) if (~held).any() else None
    threshold = 0.5
    if p is not None and (held & (y == 1)).any():
        h = part(held)
        prob = 1 - sigmoid(cuts_of(p)[0] - scores(p["w"], h["row"], h["feat"], h["val"], int(held.sum())))
        threshold = pick_threshold(prob, y[held] == 1, weight[held], beta)
    p = fit_ordinal(m, g, weight, n_feat, GRADES)
    return {"keys": keys, "w": p["w"], "cuts": cuts_of(p), "threshold": float(threshold)}


def hash_fold(k: str, folds: int = 5) -> int:
    import zlib
    return zlib.crc32(k.encode()) % folds


def pick_threshold(prob: np.ndarray, truth: np.ndarray, weight: np.ndarray, beta: float) -> float:
    """Threshold of the greatest F-beta (beta above 1 favours recall), 0.5 at most."""
    order = np.argsort(-prob, kind="stable")
    p, tp = prob[order], np.cumsum((weight * truth)[order])
    on = np.cumsum(weight[order])
    last = np.append(p[1:] != p[:-1], True)
    f = (1 + beta ** 2) * tp / (beta ** 2 * weight[truth].sum() + on)
    return float(min(max(p[last][f[last].argmax()], 1e-6), 0.5))


def score(docs: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, severity, grade, p_toxic, toxic) for every row."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)       # a few thousand numbers
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        md = shared.value
        hasher, look = SpanHash(), Lookup(md["keys"])
        cuts = md["cuts"]
        for b in batches:
            n = b.num_rows
            s, some = np.zeros(n), np.zeros(n, bool)
            for lo, hi, row, feat, val, _, n_words in featurize(b.column(1), look, hasher):
                s[lo:hi] = scores(md["w"], row, feat, val, hi - lo)
                some[lo:hi] = n_words > 0
            above = 1 - sigmoid(cuts[None, :] - s[:, None])          # P(grade > k)
            mass = np.concatenate([1 - above[:, :1], above[:, :-1] - above[:, 1:], above[:, -1:]], axis=1)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(above.sum(axis=1)), pa.array(mass.argmax(axis=1).astype(np.int32)),
                 pa.array(above[:, 0]), pa.array((above[:, 0] >= md["threshold"]) & some)],
                names=[key, "severity", "grade", "p_toxic", "toxic"])

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(
        run, f"`{key}` {kind}, severity double, grade int, p_toxic double, toxic boolean")
