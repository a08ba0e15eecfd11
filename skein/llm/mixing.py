"""Operator 3: mixing sources to target weights with soft domain membership.

A softmax classifier fitted on a bounded sample of the labelled table gives
every document posteriors p over domains. Document rates r >= 0 (optionally
r <= ``max_rate``) are fitted so that the expected domain token totals
S_k = sum_d r_d * tokens_d * p_dk match T_k = weight_k * total, by projected
gradient least squares on

    1/2 * sum_k (S_k - T_k)^2 / (N * s_k),  s_k = S_k(r=1), N = sum of tokens,

starting at r = 1. Scaled by tokens, the gradient of r_d is p_d . e with
e_k = (S_k - T_k) / s_k, and the Hessian's largest eigenvalue is 1, so the
step is 1; Nesterov momentum speeds it up. Each iteration is one distributed sum: workers
replay the short history of e on their documents' posteriors, so no rate table
is rewritten and a lost executor costs nothing but its tasks.

``copies`` turns a rate into whole copies, floor(rate + u) with u a hash of
the key: expected copies equal the rate.

Cases: null and empty texts have 0 tokens, the prior as posteriors and a rate
like any document of these posteriors; a domain without labelled documents or tokens gets no
mass and its target is ignored; with no labels at all there is one domain and
every rate meets the total; repeated rows are counted one by one; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm.bytesops import SpanHash
from skein.llm.hashfeat import (N_SHAPE, Adam, Lookup, collect_matrix, featurize, sample_labelled, select_words)
from skein.llm.scratch import bound_batches, save

DOMAINS = ("good", "poor", "toxic")


def domain_of(quality: str = "quality", toxic: str = "toxic") -> Column:
    """Domain of a labelled document: toxic, else poor quality, else good."""
    return F.when(F.col(toxic) > 0, 2).when(F.col(quality) == 0, 1).when(F.col(quality) > 0, 0)


def softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def logits(p: dict, row, feat, val, shape, n: int) -> np.ndarray:
    out = shape @ p["s"] + p["b"]
    for k in range(out.shape[1]):
        if len(row):
            out[:, k] += np.bincount(row, p["w"][feat, k] * val, n)
    return out


def fit_domains(docs: DataFrame, labels: DataFrame, target: Column, n_domains: int, key: str = "doc_id",
                text: str = "text", per_class: int = 4000, n_words: int = 512, steps: int = 300,
                l2: float = 1e-3) -> dict:
    """Softmax regression on the bounded labelled sample, weighted back to the labelled class sizes."""
    sample, sizes = sample_labelled(docs, labels, target, per_class, key, text)
    present = [k for k in range(n_domains) if sizes.get(k, 0) > 0]
    if not present:
        return {"keys": np.zeros(0, np.uint64), "w": np.zeros((1, n_domains)), "s": np.zeros((N_SHAPE, n_domains)),
                "b": np.where(np.arange(n_domains) == 0, 0.0, -60.0)}
    sample = sample.persist()                  # bounded by per_class
    keys = select_words(sample, n_domains, n_words)
    m = collect_matrix(sample, keys)
    sample.unpersist()
    y, n, n_feat = m["y"].astype(np.int64), len(m["y"]), max(len(keys), 1)
    got = np.bincount(y, minlength=n_domains)
    true = np.array([sizes.get(k, 0) for k in range(n_domains)], float)
    weight = (true / np.maximum(got, 1))[y]
    weight = weight / max(weight.sum(), 1e-12)
    prior = np.where(got > 0, np.log(np.maximum(true, 1) / max(true.sum(), 1)), -60.0)
    p = {"w": np.zeros((n_feat, n_domains)), "s": np.zeros((N_SHAPE, n_domains)), "b": prior.copy()}
    opt, val, shape = Adam(p, 0.05), m["val"].astype(np.float64), m["shape"].astype(np.float64)
    hot = np.eye(n_domains)[y]
    for _ in range(steps if n else 0):
        g = (softmax(logits(p, m["row"], m["feat"], val, shape, n)) - hot) * weight[:, None]
        g[:, got == 0] = 0
        gw = np.stack([np.bincount(m["feat"], g[m["row"], k] * val, n_feat) for k in range(n_domains)], axis=1)
        opt.step(p, {"w": gw + l2 * p["w"] / n_feat, "s": shape.T @ g + l2 * p["s"] / n_feat, "b": g.sum(axis=0)})
    return {"keys": keys, **p}


def posteriors(docs: DataFrame, model: dict, names: Sequence[str], key: str = "doc_id",
               text: str = "text") -> DataFrame:
    """(key, tokens, p_<domain>...): tokens are words."""
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)       # a few thousand numbers
    kind = docs.select(key).schema[0].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        md = shared.value
        hasher, look = SpanHash(), Lookup(md["keys"])
        for b in batches:
            post, tok = np.zeros((b.num_rows, len(names))), np.zeros(b.num_rows, np.int64)
            for lo, hi, row, feat, val, shp, n_words in featurize(b.column(1), look, hasher):
                post[lo:hi] = softmax(logits(md, row, feat, val, shp, hi - lo))
                tok[lo:hi] = n_words
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(tok), *[pa.array(post[:, k].copy()) for k in
                                              range(len(names))]], names=[key, "tokens", *[f"p_{x}" for x in names]])

    return docs.select(key, F.col(text).cast("string").alias("_t")).mapInArrow(
        run, f"`{key}` {kind}, tokens long, " + ", ".join(f"`p_{x}` double" for x in names))


def replay(post: np.ndarray, history: Sequence[np.ndarray], max_rate: float | None,
           hold: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rates, look-ahead point) after the projected steps with the residuals in ``history``. Rows whose likeliest
    domain is ``hold`` keep rate 1."""
    r = np.ones(len(post))
    if hold is not None:
        free = post.argmax(axis=1) != hold
        ahead = r.copy()
        r[free], ahead[free] = replay(post[free], history, max_rate)
        return r, ahead
    ahead, t = r, 1.0
    for e in history:
        new = np.clip(ahead - post @ e, 0.0, max_rate)
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / nt * (new - r)
        r, t = new, nt
    return r, ahead


def fit_rates(post: DataFrame, names: Sequence[str], weights: Sequence[float], total: float | None = None,
              max_rate: float | None = None, keep: str | None = None, slack: float = 1.0, tol: float = 1e-4,
              max_steps: int = 40) -> tuple[list, dict]:
    """Residual history of the projected gradient, and a report.

    ``total``: target tokens. Default: all expected tokens; with ``keep``, the rows whose likeliest domain that is
    keep rate 1, and the total is as many tokens as give their expected tokens of it its weight, times ``slack``; with
    ``max_rate`` alone, the most that can meet the weights, times ``slack``. No domain is asked for more tokens than
    there are, nor for fewer than the rows that are kept hold. The steps end when the targets are met within ``tol`` of the total or, with ``keep``, when
    three steps in a row have changed nothing more (``stationary``): the report tells the residual either way."""
    cols = [f"p_{x}" for x in names]
    w = np.array(weights, float)
    if len(w) != len(names) or (w < 0).any() or w.sum() <= 0:
        raise ValueError("one nonnegative target weight per domain, not all zero")

    hold = list(names).index(keep) if keep is not None and w[list(names).index(keep)] > 0 else None

    def sums(history):
        """Expected tokens of each domain at the look-ahead point, at the rates, and of the rows that are held."""

        def run(batches):
            import pyarrow as pa
            for b in batches:
                p = np.stack([b.column(1 + k).to_numpy() for k in range(len(cols))], axis=1)
                tok = b.column(0).to_numpy().astype(float)
                r, ahead = replay(p, history, max_rate, hold)
                held = tok * (p.argmax(axis=1) == hold) if hold is not None else 0 * tok
                yield pa.RecordBatch.from_arrays([pa.array(["ahead", "rate", "held"])] + [
                    pa.array([float((tok * ahead) @ p[:, k]), float((tok * r) @ p[:, k]), float(held @ p[:, k])])
                    for k in range(len(cols))], names=["at", *cols])

        out = post.select("tokens", *cols).mapInArrow(run, "at string, " + ", ".join(f"`{c}` double" for c in cols)) \
            .groupBy("at").agg(*[F.sum(c).alias(c) for c in cols]).collect()      # three rows
        got = {r["at"]: np.array([r[c] for c in cols]) for r in out}
        return [got.get(x, np.zeros(len(cols))) for x in ("ahead", "rate", "held")]

    base, _, held = sums([])
    live = base > 0
    w = np.where(live, w, 0.0)
    if not live.any() or w.sum() == 0:
        return [], {"base": base, "target": base, "reached": base, "steps": 0}
    w = w / w.sum()
    if total is None:
        use = w > 0
        if hold is not None and w[hold] > 0:
            total = float(held[hold] / w[hold]) * slack
        elif max_rate is not None:
            total = float((base[use] / w[use]).min()) * max_rate * slack
        else:
            total = float(base.sum())
    goal = w * total
    if hold is not None:
        goal = np.maximum(np.minimum(goal, base), held)
    history: list[np.ndarray] = []
    ahead, reached, quiet = base, base, 0
    for _ in range(max_steps):
        if np.abs(reached - goal)[live].max() <= tol * total or hold is not None and quiet >= 3:
            break
        history.append(np.where(live, (ahead - goal) / np.maximum(base, 1e-12), 0.0))
        before = reached
        ahead, reached, _ = sums(history)
        quiet = quiet + 1 if np.abs(reached - before).max() <= 0.1 * tol * total else 0
    return history, {"base": base, "target": goal, "reached": reached, "steps": len(history), "stationary": quiet >= 3,
                     "residual": float(np.abs(reached - goal)[live].max() / max(total, 1e-12))}


def with_rates(post: DataFrame, names: Sequence[str], history: Sequence[np.ndarray], max_rate: float | None = None,
               key: str = "doc_id", seed: int = 42) -> DataFrame:
    """Adds rate and copies (whole copies whose expectation is the rate)."""
    cols = [f"p_{x}" for x in names]
    ix = [post.columns.index(c) for c in cols]

    def run(batches):
        import pyarrow as pa
        for b in batches:
            p = np.stack([b.column(k).to_numpy() for k in ix], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(replay(p, history, max_rate)[0])],
                                             names=[*b.schema.names, "rate"])

    out = post.mapInArrow(run, T.StructType([*post.schema.fields, T.StructField("rate", T.DoubleType())]))
    u = F.xxhash64(F.col(key).cast("string"), F.lit(f"copies{seed}")).bitwiseAND(F.lit((1 << 52) - 1)) \
        / F.lit(float(1 << 52))
    return out.withColumn("copies", F.floor(F.col("rate") + u).cast("bigint"))


def mix(docs: DataFrame, labels: DataFrame, weights: dict[str, float], target: Column | None = None,
        max_rate: float | None = None, slack: float = 1.0, key: str = "doc_id", text: str = "text",
        per_class: int = 4000) -> tuple[DataFrame, dict]:
    """(rows, report): classifier, posteriors (written once), rates and copies."""
    names = list(weights)
    model = fit_domains(docs, labels, domain_of() if target is None else target, len(names), key, text, per_class)
    post = save(posteriors(docs, model, names, key, text), "posteriors")
    history, report = fit_rates(post, names, [weights[x] for x in names], max_rate=max_rate, slack=slack)
    return with_rates(post, names, history, max_rate, key), report


def thin(docs: DataFrame, labels: DataFrame, weights: dict[str, float], target: Column | None = None,
         keep: str | None = "good", slack: float = 1.0, key: str = "doc_id", text: str = "text", per_class: int = 4000,
         seed: int = 42) -> tuple[DataFrame, dict]:
    """(input rows kept, report): rates of at most 1, each row kept with its rate as probability.

    Posteriors are computed again while filtering, so texts are not shuffled.
    Documents whose likeliest domain is ``keep`` stay (rate 1), and the
    others are thinned to their weights next to it; see ``fit_rates``."""
    names = list(weights)
    model = fit_domains(docs, labels, domain_of() if target is None else target, len(names), key, text, per_class)
    post = save(posteriors(docs, model, names, key, text), "posteriors")
    history, report = fit_rates(post, names, [weights[x] for x in names], max_rate=1.0, keep=keep, slack=slack)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)
    hold = names.index(keep) if keep is not None and weights[keep] > 0 else None
    draw = "_draw"
    while draw in docs.columns:
        draw += "_"

    def run(batches):
        import pyarrow as pa
        md = shared.value
        hasher, look = SpanHash(), Lookup(md["keys"])
        for b in batches:
            post_ = np.zeros((b.num_rows, len(names)))
            for lo, hi, row, feat, val, shp, _ in featurize(b.column(at), look, hasher):
                post_[lo:hi] = softmax(logits(md, row, feat, val, shp, hi - lo))
            rate = replay(post_, history, 1.0, hold)[0]
            u = b.column(b.num_columns - 1).to_numpy()
            yield pa.RecordBatch.from_arrays(b.columns[:-1], names=b.schema.names[:-1]).filter(
                pa.array(u < rate))

    u = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f"thin{seed}")) \
        .bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return docs.withColumn(draw, u).mapInArrow(run, docs.schema), report
