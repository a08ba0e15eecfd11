"""Queries for keyed vectors (J1-J6) and vector RMS norm."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions.hashing import hash_uniform
from skein.operators import tokens as T
from skein.operators import vectors as J
from skein.plans.derive import PRED_SQL, pred_rows, sql_hash_uniform
from skein.plans.registry import ORACLE, load, register

SEED = 42


def _emb(spark, sf):
    return load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"),
                                                "label")


def vector_lookup(spark, sf):
    """All byte ids of each benchmark item -> embedding rows -> mean pooled."""
    bench = load(spark, sf, "benchmark").select("item_id", "text")
    ids = T.tokenize_bytes(bench, ["item_id"], "text", None).select("item_id", "ids")
    # The byte tokenizer's id space is [2, 257]; only those vectors can match,
    # so the vector side is bounded by 256 rows and broadcast.
    space = F.col("id").between(T.BYTE_OFFSET, T.BYTE_OFFSET + 255)
    looked = J.lookup_vectors(ids, ["item_id"], "ids", _emb(spark, sf).filter(space), vec_rows=256)
    pooled = J.mean_pool(looked, ["item_id"])
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    return pooled.select("item_id", "n_found", F.round(total, 6).alias("pooled_sum"),
                         F.round(F.sqrt(square), 6).alias("pooled_l2"))


register("vector_lookup", """
WITH b AS (SELECT item_id, list_transform(regexp_extract_all(hex(text), '..', 0),
                  lambda h: CAST(('0x' || h) AS INTEGER) + 2) AS ids FROM benchmark),
e AS (SELECT item_id, unnest(ids) AS id FROM b),
l AS (SELECT e.item_id, x.embedding FROM e JOIN embeddings x ON x.vec_id = e.id),
n AS (SELECT item_id, count(*) AS n_found FROM l GROUP BY item_id),
d AS (SELECT item_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS dim FROM l),
p AS (SELECT item_id, dim, avg(CAST(v AS DOUBLE)) AS value FROM d GROUP BY item_id, dim)
SELECT p.item_id, n.n_found, round(sum(value), 6) AS pooled_sum, round(sqrt(sum(value * value)), 6) AS pooled_l2
FROM p JOIN n ON p.item_id = n.item_id GROUP BY p.item_id, n.n_found
""")(vector_lookup)


def vector_lookup_split(spark, sf):
    """J1 over the whole vector table: frequent ids by broadcast, the others by shuffle."""
    bench = load(spark, sf, "benchmark").select("item_id", "text")
    ids = T.tokenize_bytes(bench, ["item_id"], "text", None).select("item_id", "ids")
    looked = J.lookup_vectors_split(ids, ["item_id"], "ids", _emb(spark, sf), counters=16)
    pooled = J.mean_pool(looked, ["item_id"])
    total = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v)
    square = F.aggregate("vec", F.lit(0.0), lambda a, v: a + v * v)
    return pooled.select("item_id", "n_found", F.round(total, 6).alias("pooled_sum"),
                         F.round(F.sqrt(square), 6).alias("pooled_l2"))


register("vector_lookup_split", ORACLE["vector_lookup"])(vector_lookup_split)


def _grads(spark, sf):
    pred = pred_rows(spark, sf).filter(F.col("label") != -100)
    return J.sum_vectors(pred.select(F.col("label").alias("id"), F.col("logits").alias("grad")))


def keyed_vector_sum(spark, sf):
    """Gradients keyed by label id, summed per distinct id; shown per dimension."""
    g = _grads(spark, sf).select(F.col("id").cast("int").alias("id"), "n", F.posexplode("grad").alias("dim", "grad"))
    return g.select("id", "dim", F.round("grad", 6).alias("grad"), "n")


_GRAD_SQL = f"""{PRED_SQL},
v AS (SELECT label AS id, logits FROM pred WHERE label <> -100),
d AS (SELECT id, unnest(logits) AS g, generate_subscripts(logits, 1) - 1 AS dim FROM v),
gs AS (SELECT id, CAST(dim AS INTEGER) AS dim, sum(g) AS grad, count(*) AS n FROM d GROUP BY id, dim)"""

register("keyed_vector_sum", f"""
WITH {_GRAD_SQL}
SELECT id, dim, round(grad, 6) AS grad, n FROM gs
""")(keyed_vector_sum)


def sign_update_q(spark, sf):
    """weights = the whole embedding table as id -> vector; gradients
    touch only the label ids, every other id keeps its weights."""
    w = _emb(spark, sf).select(F.col("id").cast("int").alias("id"), F.col("vec").cast("array<double>").alias("w"))
    out = J.sign_update(w, _grads(spark, sf).withColumn("id", F.col("id").cast("int")))
    long = out.select("id", "updated", F.posexplode("w").alias("dim", "w"))
    return long.select("id", "dim", F.round("w", 6).alias("w"), "updated")


register("sign_update", f"""
WITH {_GRAD_SQL},
w AS (SELECT CAST(vec_id AS INTEGER) AS id, CAST(unnest(embedding) AS DOUBLE) AS w,
             CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS dim FROM embeddings)
SELECT w.id, w.dim,
       round(CASE WHEN gs.grad IS NULL THEN w.w ELSE w.w * (1.0 - 1e-3 * 1e-2) - 1e-3 * sign(gs.grad) END, 6) AS w,
       gs.grad IS NOT NULL AS updated
FROM w LEFT JOIN gs ON w.id = gs.id AND w.dim = gs.dim
""")(sign_update_q)


def conditional_refresh(spark, sf):
    """slots = vec_id div 2; even rows are the carried data, odd rows the
    new batch; a slot is refreshed when its (hash) halt flag is set."""
    e = load(spark, sf, "embeddings").select("vec_id", "label")
    slot = F.floor(F.col("vec_id") / 2).cast("bigint")
    old = e.filter(F.col("vec_id") % 2 == 0).select(slot.alias("slot"), "vec_id", "label")
    new = e.filter(F.col("vec_id") % 2 == 1).select(slot.alias("slot"), "vec_id", "label")
    flag = old.select("slot", (hash_uniform(SEED, F.col("slot")) < 0.5).alias("halted"))
    return J.refresh(old, new, flag, "slot")


register("conditional_refresh", f"""
WITH o AS (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS slot, vec_id, label FROM embeddings WHERE vec_id % 2 = 0),
n AS (SELECT CAST(floor(vec_id / 2) AS BIGINT) AS slot, vec_id, label FROM embeddings WHERE vec_id % 2 = 1),
f AS (SELECT slot, {sql_hash_uniform(SEED, 'slot')} < 0.5 AS halted FROM o)
SELECT o.slot, CASE WHEN f.halted AND n.vec_id IS NOT NULL THEN n.vec_id ELSE o.vec_id END AS vec_id,
       CASE WHEN f.halted AND n.vec_id IS NOT NULL THEN n.label ELSE o.label END AS label,
       coalesce(f.halted, false) AND n.vec_id IS NOT NULL AS refreshed
FROM o LEFT JOIN f ON o.slot = f.slot LEFT JOIN n ON o.slot = n.slot
""")(conditional_refresh)


def rms_norm_q(spark, sf):
    e = load(spark, sf, "embeddings").select("vec_id", J.rms_norm("embedding").alias("y"))
    return e.select("vec_id",
                    F.round(F.aggregate("y", F.lit(0.0), lambda a, v: a + v), 6).alias("y_sum"),
                    F.round(F.array_max("y"), 6).alias("y_max"),
                    F.round(F.sqrt(F.aggregate("y", F.lit(0.0), lambda a, v: a + v * v) / F.size("y")), 6)
                    .alias("y_rms"))


register("rms_norm", """
WITH x AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
m AS (SELECT vec_id, v, list_sum(list_transform(v, lambda a: a * a)) / len(v) AS ms FROM x),
y AS (SELECT vec_id, list_transform(v, lambda a: a / sqrt(ms + 1e-5)) AS y FROM m)
SELECT vec_id, round(list_sum(y), 6) AS y_sum, round(list_max(y), 6) AS y_max,
       round(sqrt(list_sum(list_transform(y, lambda a: a * a)) / len(y)), 6) AS y_rms
FROM y
""")(rms_norm_q)


def resize_vectors_q(spark, sf):
    """Grow the embedding table by 64 ids; new rows are seeded normals."""
    e = _emb(spark, sf)
    old_n = e.agg(F.max("id")).collect()[0][0] + 1
    out = J.resize_vectors(e, old_n, old_n + 64, 64, SEED)
    return out.select("id", "is_new", F.size("vec").alias("dim"),
                      F.round(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v), 4).alias("vec_sum"))


# New rows: Box-Muller over two md5 uniforms per (id, dim), times the initial deviation.
register("resize_vectors", f"""
WITH m AS (SELECT max(vec_id) + 1 AS n FROM embeddings),
k AS (SELECT unnest(range((SELECT n FROM m), (SELECT n + 64 FROM m))) AS id),
g AS (SELECT id, unnest(range(64)) AS dim FROM k),
z AS (SELECT id, {J.INIT_STD!r}::DOUBLE * sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {sql_hash_uniform(SEED, "'a'", 'id', 'dim')}))
             * cos(6.283185307179586::DOUBLE * {sql_hash_uniform(SEED, "'b'", 'id', 'dim')}) AS v FROM g)
SELECT id, true AS is_new, CAST(count(*) AS INTEGER) AS dim, round(sum(v), 4) AS vec_sum FROM z GROUP BY id
UNION ALL
SELECT vec_id, false, CAST(len(embedding) AS INTEGER), round(list_sum(CAST(embedding AS DOUBLE[])), 4) FROM embeddings
""")(resize_vectors_q)
