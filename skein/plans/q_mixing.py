"""Queries for packing, mixing, shuffles and batch plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import batches as N
from skein.operators import drawindex as D
from skein.operators import mixing as M
from skein.operators import packing as K
from skein.operators import permute as P
from skein.operators import tokens as T
from skein.operators.ordering import global_index
from skein.plans.derive import sources, sql_hash_long, sql_hash_uniform
from skein.plans.q_sampling import MIX_SPECS
from skein.plans.q_tokens import VOCAB, _vocab_sql
from skein.plans.registry import load, register
from skein.sources.mix import build_mix, normalise_mix

SEED = 42
BLOCK = 512
GROUP_ROWS = 100
WEIGHTS = {s["name"]: float(s["weight"]) for s in MIX_SPECS}


def _weights_sql() -> str:
    tot = sum(WEIGHTS.values())
    rows = ", ".join(f"('{s}', {i}, {w}, {w / tot!r})" for i, (s, w) in enumerate(WEIGHTS.items()))
    return f"(VALUES {rows}) AS m(source, src_pos, weight, weight_norm)"


def _case_sql(u: str) -> str:
    tot = sum(WEIGHTS.values())
    cum, parts = 0.0, []
    items = list(WEIGHTS.items())
    for i, (s, w) in enumerate(items):
        cum += w / tot
        bound = 1.0 if i == len(items) - 1 else cum
        parts.append(f"WHEN {u} < {bound!r} THEN '{s}'")
    return "CASE " + " ".join(parts) + f" ELSE '{items[-1][0]}' END"


# ---------------------------------------------------------------------------
# K1/K2: packing in groups of 100 rows, and over the whole corpus.

def pack_grouped(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    vocab = T.build_vocab(docs, "text", VOCAB)
    out = K.pack(docs, vocab, ["doc_id"], BLOCK, "text", GROUP_ROWS)
    return out.select("pack_group", "block", "n_tok", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


def _pack_sql(group_expr: str) -> str:
    return f"""
WITH {_vocab_sql()},
r AS (SELECT doc_id, toks, {group_expr} AS pack_group, len(toks) AS n FROM tk),
o AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY pack_group ORDER BY doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             sum(n) OVER (PARTITION BY pack_group) AS total FROM r),
e AS (SELECT pack_group, total, off, generate_subscripts(toks, 1) AS p, unnest(toks) AS tok FROM o),
b AS (SELECT pack_group, total, off + p - 1 AS o, tok, CAST(floor((off + p - 1) / {BLOCK}) AS BIGINT) AS block FROM e),
f AS (SELECT b.pack_group, b.block, b.o, coalesce(v.id, 1) AS id FROM b LEFT JOIN vocab v ON b.tok = v.token
      WHERE b.total < {BLOCK} OR (b.block + 1) * {BLOCK} <= b.total)
SELECT pack_group, block, CAST(count(*) AS INTEGER) AS n_tok,
       md5(array_to_string(list(id ORDER BY o), ',')) AS ids_md5
FROM f GROUP BY pack_group, block
"""


register("pack_grouped", _pack_sql(
    f"CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {GROUP_ROWS}) AS BIGINT)"))(pack_grouped)


def pack_global(spark, sf):
    docs = load(spark, sf, "documents").select("doc_id", "text")
    vocab = T.build_vocab(docs, "text", VOCAB)
    out = K.pack(docs, vocab, ["doc_id"], BLOCK, "text", None)
    return out.select("pack_group", "block", "n_tok", F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


register("pack_global", _pack_sql("CAST(0 AS BIGINT)"))(pack_global)


COLUMN_BLOCK = 4096


def pack_columns(spark, sf):
    """K1 on several list columns at once: byte ids and each token's place in its text."""
    docs = load(spark, sf, "documents").select("doc_id", "text")
    ids = T.byte_ids("text")                               # made after the shuffles, which move the texts
    lists = {"ids": ids, "place": F.transform(ids, lambda x, i: i)}
    out = K.pack_lists(docs, lists, ["doc_id"], COLUMN_BLOCK, GROUP_ROWS)
    return out.select("pack_group", "block", "n_tok", F.md5(F.array_join("ids", ",")).alias("ids_md5"),
                      F.md5(F.array_join("place", ",")).alias("place_md5"))


register("pack_columns", f"""
WITH r AS (SELECT doc_id, list_transform(regexp_extract_all(hex(text), '..', 0),
                  lambda h: CAST(('0x' || h) AS INTEGER) + 2) AS ids,
                  CAST(floor((row_number() OVER (ORDER BY doc_id) - 1) / {GROUP_ROWS}) AS BIGINT) AS pack_group FROM documents),
o AS (SELECT *, coalesce(sum(len(ids)) OVER (PARTITION BY pack_group ORDER BY doc_id
                                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off,
             sum(len(ids)) OVER (PARTITION BY pack_group) AS total FROM r),
e AS (SELECT pack_group, total, off + generate_subscripts(ids, 1) - 1 AS o, unnest(ids) AS id,
             generate_subscripts(ids, 1) - 1 AS place FROM o),
b AS (SELECT *, CAST(floor(o / {COLUMN_BLOCK}) AS BIGINT) AS block FROM e)
SELECT pack_group, block, CAST(count(*) AS INTEGER) AS n_tok, md5(array_to_string(list(id ORDER BY o), ',')) AS ids_md5,
       md5(array_to_string(list(place ORDER BY o), ',')) AS place_md5
FROM b WHERE total < {COLUMN_BLOCK} OR (block + 1) * {COLUMN_BLOCK} <= total GROUP BY pack_group, block
""")(pack_columns)


# ---------------------------------------------------------------------------
# M1: normalised weights next to each source's size.

def mix_weights(spark, sf):
    mix = normalise_mix(build_mix(spark, MIX_SPECS)).select("source", "src_pos", "weight", "weight_norm")
    n = sources(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n_rows"))
    return mix.join(n, "source", "left").select(
        "source", "src_pos", "weight", F.round("weight_norm", 6).alias("weight_norm"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
        F.round(F.col("n_rows") / F.col("weight_norm"), 6).alias("draws_to_cover"))


register("mix_weights", f"""
WITH n AS (SELECT lang AS source, count(*) AS n_rows FROM documents GROUP BY lang)
SELECT m.source, CAST(m.src_pos AS INTEGER) AS src_pos, CAST(m.weight AS DOUBLE) AS weight,
       round(CAST(m.weight_norm AS DOUBLE), 6) AS weight_norm,
       coalesce(n.n_rows, 0) AS n_rows, round(n.n_rows / CAST(m.weight_norm AS DOUBLE), 6) AS draws_to_cover
FROM {_weights_sql()} LEFT JOIN n ON m.source = n.source
""")(mix_weights)


# ---------------------------------------------------------------------------
# M2/M3: weighted interleave until every source has been read once.

def interleave_ctes(stop: str = "all_exhausted") -> str:
    """CTEs d, u, c, n, e, p (plan: k, source, row, epoch) and r (row -> doc_id)."""
    if stop == "all_exhausted":
        k_end = """e AS (SELECT max(k_end) + 1 AS K FROM (SELECT c.source, min(c.k) AS k_end FROM c JOIN n ON c.source = n.source
                   WHERE c.c = n.n - 1 GROUP BY c.source))"""
    else:
        k_end = """e AS (SELECT min(c.k) + 1 AS K FROM c JOIN n ON c.source = n.source WHERE c.c = n.n - 1)"""
    return f"""
d AS (SELECT unnest(range((SELECT CAST(2 * max(n.n / m.weight_norm) AS BIGINT) + 1000
      FROM {_weights_sql()} JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) n ON n.lang = m.source))) AS k),
u AS (SELECT k, {_case_sql(sql_hash_uniform(SEED, "'mix'", 'k'))} AS source FROM d),
c AS (SELECT k, source, row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS c FROM u),
n AS (SELECT lang AS source, count(*) AS n FROM documents GROUP BY lang),
{k_end},
p AS (SELECT c.k, c.source, c.c % n.n AS row, CAST(c.c // n.n AS BIGINT) AS epoch
      FROM c JOIN n ON c.source = n.source, e WHERE c.k < e.K),
r AS (SELECT lang AS source, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS row FROM documents)"""


def _interleave_sql(stop: str) -> str:
    return f"""
WITH {interleave_ctes(stop)}
SELECT p.k, p.source, p.epoch, r.doc_id FROM p JOIN r ON p.source = r.source AND p.row = r.row
"""


def interleave_exhausted(spark, sf):
    data = sources(spark, sf).select("source", "idx", "doc_id")
    out = M.interleave(spark, data, WEIGHTS, ["idx"], SEED, "all_exhausted")
    return out.select("k", "source", "epoch", "doc_id")


register("interleave_exhausted", _interleave_sql("all_exhausted"))(interleave_exhausted)


def interleave_first(spark, sf):
    data = sources(spark, sf).select("source", "idx", "doc_id")
    out = M.interleave(spark, data, WEIGHTS, ["idx"], SEED, "first_exhausted")
    return out.select("k", "source", "epoch", "doc_id")


register("interleave_first", _interleave_sql("first_exhausted"))(interleave_first)


# ---------------------------------------------------------------------------
# M4: global and buffered shuffles.

def shuffle_global_q(spark, sf):
    src = sources(spark, sf).select("source", "idx")
    return M.shuffle_global(src, ["source", "idx"], SEED)


register("shuffle_global", f"""
SELECT lang AS source, doc_id AS idx,
       CAST(row_number() OVER (ORDER BY {sql_hash_long(SEED, "'shuffle'", 'lang', 'doc_id')}, lang, doc_id) - 1 AS BIGINT) AS pos
FROM documents
""")(shuffle_global_q)


def shuffle_buffered_q(spark, sf):
    d = load(spark, sf, "documents").select("doc_id")
    return M.shuffle_buffered(d, "doc_id", 100, SEED)


register("shuffle_buffered", f"""
SELECT doc_id,
       CAST(floor(doc_id / 100) * 100 + row_number() OVER (PARTITION BY floor(doc_id / 100)
            ORDER BY {sql_hash_long(SEED, "'shuffle'", 'doc_id')}, doc_id) - 1 AS BIGINT) AS pos
FROM documents
""")(shuffle_buffered_q)


def concat_sources(spark, sf):
    src = sources(spark, sf)
    parts = [src.filter(F.col("source") == s).select("source", "idx", F.length("text").alias("n_chars"))
             for s in WEIGHTS]
    return M.concat(parts)


register("concat_sources", """
SELECT lang AS source, doc_id AS idx, CAST(length(text) AS INTEGER) AS n_chars FROM documents
""")(concat_sources)


# ---------------------------------------------------------------------------
# Batch plan over two shuffled epochs; capped and resumed plan.

def _batch_sql(max_steps: int | None, resume: int | None) -> str:
    cond = ""
    if max_steps is not None:
        cond += f" AND (epoch * per + pos // 8) // 4 < {max_steps}"
    if resume is not None:
        cond += f" AND (epoch * per + pos // 8) // 4 >= {resume}"
    return f"""
WITH d AS (SELECT doc_id, e.epoch FROM documents, (SELECT range AS epoch FROM range(2)) e),
p AS (SELECT doc_id, epoch,
             row_number() OVER (PARTITION BY epoch ORDER BY {sql_hash_long(SEED, "'epoch'", 'epoch', 'doc_id')}, doc_id) - 1 AS pos
      FROM d),
n AS (SELECT count(*) // 8 AS per FROM documents)
SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, CAST(pos AS BIGINT) AS pos,
       CAST(epoch * per + pos // 8 AS BIGINT) AS batch, CAST((epoch * per + pos // 8) // 4 AS BIGINT) AS step
FROM p, n WHERE pos < per * 8 {cond}
"""


def batch_plan(spark, sf):
    d = load(spark, sf, "documents").select("doc_id")
    return N.plan_batches(d, ["doc_id"], batch=8, accum=4, drop_last=True, epochs=2, seed=SEED) \
        .select("doc_id", "epoch", "pos", "batch", "step")


register("batch_plan", _batch_sql(None, None))(batch_plan)


def resume_plan(spark, sf):
    d = load(spark, sf, "documents").select("doc_id")
    plan = N.plan_batches(d, ["doc_id"], batch=8, accum=4, drop_last=True, epochs=2, max_steps=40, seed=SEED)
    return N.resume(plan, 5).select("doc_id", "epoch", "pos", "batch", "step")


register("resume_plan", _batch_sql(40, 5))(resume_plan)


# ---------------------------------------------------------------------------
# M4: the order in which a shuffle buffer gives rows out; many slots and few.

RESERVOIR, RESERVOIR_SMALL = 1000, 8


def _numbered(spark, sf):
    return global_index(load(spark, sf, "documents").select("doc_id"), ["doc_id"], name="t")


def _reservoir_sql(buffer: int) -> str:
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS t, count(*) OVER () AS n FROM documents),
s AS (SELECT *, CASE WHEN t < {buffer} THEN t ELSE {sql_hash_long(SEED, "'slot'", 't')} % {buffer} END AS slot FROM d),
l AS (SELECT *, lead(t) OVER (PARTITION BY slot ORDER BY t) AS nxt FROM s),
e AS (SELECT slot, row_number() OVER (ORDER BY {sql_hash_long(SEED, "'rest'", 'slot')}, slot) - 1 AS r FROM (SELECT DISTINCT slot FROM s))
SELECT doc_id, t, CAST(coalesce(nxt - {buffer}, greatest(n - {buffer}, 0) + r) AS BIGINT) AS pos FROM l JOIN e USING (slot)
"""


def shuffle_reservoir_q(spark, sf):
    return M.shuffle_reservoir(_numbered(spark, sf), "t", RESERVOIR, SEED)


def shuffle_reservoir_small_q(spark, sf):
    return M.shuffle_reservoir(_numbered(spark, sf), "t", RESERVOIR_SMALL, SEED)


register("shuffle_reservoir", _reservoir_sql(RESERVOIR))(shuffle_reservoir_q)
register("shuffle_reservoir_small", _reservoir_sql(RESERVOIR_SMALL))(shuffle_reservoir_small_q)


# ---------------------------------------------------------------------------
# Epoch orders by a keyed permutation of one numbering; steps read back from it.

EPOCHS = 3


def _network_sql(source: str, v: str) -> str:
    """``source`` with column ``w``: where the network sends ``v`` (columns a, b and k0.. are there)."""
    def mixed(x, r):
        y = f"(({x} + k{r}) % {P.MODULUS} * {P.STEP} % {P.MODULUS})"
        return f"(xor({y}, {y} >> 15) * {P.MIX} % {P.MODULUS})"

    out = f"(SELECT *, {v} // b AS l, {v} % b AS r FROM {source})"
    for i in range(P.ROUNDS):
        change = f"(l + {mixed('r', i)}) % a AS l" if i % 2 == 0 else f"(r + {mixed('l', i)}) % b AS r"
        out = f"(SELECT * REPLACE ({change}) FROM {out})"
    return f"(SELECT * EXCLUDE (l, r), l * b + r AS w FROM {out})"


def _epochs_sql(cond: str) -> str:
    names = ", ".join(f"k{r}" for r in range(P.ROUNDS))
    keys = ", ".join(f"({e}, {', '.join(map(str, P.round_keys(SEED, e)))})" for e in range(EPOCHS))
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i, count(*) OVER () AS n FROM documents),
s AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM d),
z AS (SELECT s.*, (n + a - 1) // a AS b, x.* FROM s, (VALUES {keys}) x(epoch, {names})),
y AS (SELECT doc_id, n, a, b, epoch, {names}, w FROM {_network_sql('z', 'i')}
      UNION ALL SELECT doc_id, n, a, b, epoch, {names}, w FROM {_network_sql('(SELECT y.* EXCLUDE (w), w AS v FROM y WHERE w >= n)', 'v')}),
p AS (SELECT doc_id, CAST(epoch AS BIGINT) AS epoch, CAST(w AS BIGINT) AS pos, n // 8 AS per FROM y WHERE w < n)
SELECT doc_id, epoch, pos, CAST(epoch * per + pos // 8 AS BIGINT) AS batch, CAST((epoch * per + pos // 8) // 4 AS BIGINT) AS step
FROM p WHERE pos < per * 8 {cond}
"""


def epoch_plan(spark, sf):
    d = load(spark, sf, "documents").select("doc_id")
    return P.plan_epochs(d, ["doc_id"], batch=8, accum=4, drop_last=True, epochs=EPOCHS, seed=SEED) \
        .select("doc_id", "epoch", "pos", "batch", "step")


register("epoch_plan", _epochs_sql(""))(epoch_plan)


def epoch_resume(spark, sf):
    """The steps of the second half of an epoch and the first half of the next, without the plan."""
    d = _numbered(spark, sf)
    n = d.count()
    first = n // 8 // 4 // 2
    rows = P.rows_of_steps(spark, n, batch=8, accum=4, first_step=first, last_step=3 * first, drop_last=True, seed=SEED)
    return rows.join(d.withColumnRenamed("t", "idx"), "idx").select("doc_id", "epoch", "pos", "batch", "step")


_FIRST = "(n.c // 8 // 4 // 2)"
register("epoch_resume", f"""
SELECT p.* FROM ({_epochs_sql('')}) p, (SELECT count(*) AS c FROM documents) n
WHERE step >= {_FIRST} AND step < 3 * {_FIRST}
""")(epoch_resume)


# ---------------------------------------------------------------------------
# The mix from an index of draw counts; a part of it; the cursors at a position.

DRAW_BLOCK = 256


def interleave_indexed_q(spark, sf):
    data = sources(spark, sf).select("source", "idx", "doc_id")
    return D.interleave_indexed(spark, data, WEIGHTS, ["idx"], SEED, block=DRAW_BLOCK).select("k", "source", "epoch", "doc_id")


register("interleave_indexed", _interleave_sql("all_exhausted"))(interleave_indexed_q)


def interleave_resume(spark, sf):
    """The mix from a position on, as a job that stopped there goes on."""
    data = sources(spark, sf).select("source", "idx", "doc_id")
    at = data.count() // 2
    return D.interleave_indexed(spark, data, WEIGHTS, ["idx"], SEED, start=at, block=DRAW_BLOCK).select("k", "source", "epoch", "doc_id")


register("interleave_resume", f"""
SELECT i.* FROM ({_interleave_sql("all_exhausted")}) i, (SELECT count(*) // 2 AS half FROM documents) WHERE k >= half
""")(interleave_resume)


def mix_cursors(spark, sf):
    """Rows read of each source before the middle of the mix, and its next row and epoch."""
    got = {r["source"]: int(r["n"]) for r in sources(spark, sf).groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    sizes = {s: got[s] for s in WEIGHTS if s in got}
    index, total = D.draw_index(spark, sizes, WEIGHTS, SEED, block=DRAW_BLOCK)
    seen = index.rank(total // 2)
    return spark.createDataFrame([(s, c, c % sizes[s], c // sizes[s]) for s, c in seen.items()],
                                 "source string, drawn long, next_row long, epoch long")


register("mix_cursors", f"""
WITH {interleave_ctes("all_exhausted")},
m AS (SELECT K // 2 AS half FROM e), x AS (SELECT c.source, count(*) AS drawn FROM c, m WHERE c.k < m.half GROUP BY c.source)
SELECT n.source, coalesce(drawn, 0) AS drawn, coalesce(drawn, 0) % n.n AS next_row, coalesce(drawn, 0) // n.n AS epoch
FROM n LEFT JOIN x ON x.source = n.source WHERE n.source IN ({", ".join(f"'{s}'" for s in WEIGHTS)})
""")(mix_cursors)
