"""Queries of this subpackage: one thin ``opN_*`` per operator, with DuckDB SQL
where SQL can express the operator."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import (kdsearch, langid, licenses, merkle, mixing, neardup, ngramjoin, packing, periodic, pii,
                       secrets, toxicity, urls)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLE)


# --- op6 -------------------------------------------------------------------

_SEP = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def _license_sql() -> str:
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = []
    for phrase, label in licenses.PHRASES:
        ws = phrase.split()
        cond = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(ws))
        hits.append(f"list_transform(list_filter(range(len(w)), lambda i: {cond}), "
                    f"lambda i: {{'i': i, 'l': '{label}'}})")
    places = hits[0]
    for h in hits[1:]:
        places = f"list_concat({places}, {h})"
    temps = ", ".join(f"('{n}', {sorted(set(t.split()))})" for n, t in licenses.TEMPLATES)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
                  regexp_extract_all({lower}, '[^{_SEP}]+') AS w FROM documents),
p AS (SELECT rid, doc_id, len(w)::BIGINT AS n_words, {places} AS p FROM d),
lines AS (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d),
t(name, words) AS (VALUES {temps}),
f AS (SELECT rid, name, len(list_intersect(words, regexp_extract_all(lower(line), '[^{_SEP}]+')))::DOUBLE
             / len(words) AS c, len(words) AS m FROM lines, t),
g AS (SELECT rid, list(DISTINCT name) AS names, max(c) AS score, count(*) AS n_blocks
      FROM f WHERE c * m >= ceil({licenses.THRESHOLD} * m - 1e-9) GROUP BY rid)
SELECT doc_id, n_words, len(p)::BIGINT AS n_base,
       list_min(list_transform(p, lambda x: x.i))::BIGINT AS first_word,
       list_max(list_transform(p, lambda x: x.i))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(p, lambda x: x.l))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(list_transform(p, lambda x: x.l),
                       coalesce(names, []::VARCHAR[])))), ',') AS labels,
       CASE WHEN len(p) > 0 THEN 1.0::DOUBLE ELSE coalesce(score, 0.0::DOUBLE) END AS score,
       coalesce(n_blocks, 0)::BIGINT AS n_blocks
FROM p LEFT JOIN g USING (rid)"""


@query("op6_license_scan", _license_sql())
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


# --- op10 ------------------------------------------------------------------

_RULES_SQL = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in urls.RULES)


@query("op10_url_filter", f"""
WITH r(v, h, p) AS (VALUES {_RULES_SQL}),
u AS (SELECT row_number() OVER () AS rid, page_id,
        CASE WHEN url IS NULL OR instr(url, '://') = 0 THEN '' ELSE substr(url, instr(url, '://') + 3) END AS rest
      FROM pages),
s AS (SELECT rid, page_id, translate(regexp_extract(rest, '^[^/?#]*'),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT rid, arg_max(h || p, length(h || p)) AS rule, arg_max(v, length(h || p)) AS v
      FROM s JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY rid)
SELECT page_id, host, path, rule, coalesce(v, '{urls.DEFAULT_VERDICT}') AS verdict FROM s LEFT JOIN m USING (rid)""")
def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


# --- op3, op5, op9 -----------------------------------------------------------

MIX_WEIGHTS = {"good": 0.90, "poor": 0.06, "toxic": 0.04}


@query("op3_mix_sources")
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX_WEIGHTS)
    return out


def fold_of(key: str = "doc_id"):
    """crc32 of the key as text, modulo 4; fold 2 is held out."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4


@query("op5_language_id")
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold_of() != 2))
    out = langid.identify(docs, model, keep=["doc_id"])
    return out.select("doc_id", (fold_of() == 2).alias("held_out"), "lang_pred", "score", "n_grams")


@query("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


# --- op4 -------------------------------------------------------------------

def spans_text(findings):
    """Findings as kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


@query("op4_secret_scan")
def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secrets.scan(docs, secrets.fit(docs))

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"] != "model")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS],
                        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.col("findings")).alias("spans"), "score")


# --- op8 -------------------------------------------------------------------

def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_packing")
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


# --- op1, op2, op7 -----------------------------------------------------------

@query("op1_exact_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kdsearch.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op2_ngram_jaccard", rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
k AS (SELECT a, count(*) AS k FROM e GROUP BY a),
r(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM r JOIN e ON r.node = e.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(low)::BIGINT AS component_id,
       coalesce(any_value(k.k), 0)::BIGINT AS n_links
FROM r LEFT JOIN n ON n.doc_id = node LEFT JOIN k ON k.a = node JOIN documents d ON d.doc_id = node GROUP BY d.doc_id""")
def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join_texts(table(spark, sf_dir, "documents"), links=True)


@query("op7_embedding_neardup", """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(node, low) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.low FROM r JOIN l ON r.node = l.a),
c AS (SELECT node, min(low) AS component_id FROM r GROUP BY node),
k AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN c ON node = vec_id LEFT JOIN k ON a = vec_id""")
def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(table(spark, sf_dir, "embeddings"))


# --- op13 --------------------------------------------------------------------

LEAF_COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]
_UPPER_ABC, _LOWER_ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CRC = """(4294967295 - list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, length({x}) + 1),
    lambda i: ord(substr({x}, i, 1))::UBIGINT)), lambda c, b: xor(c >> 8, crc_t[((xor(c, b) & 255) + 1)::BIGINT])))"""
_CRC_TABLE = """crc_table AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n::UBIGINT, range(8)::UBIGINT[]),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS crc_t)"""


def crc_sql(x: str) -> str:
    """Unsigned crc32 of an ASCII text in DuckDB, where the CTE ``crc_table`` is joined."""
    return _CRC.format(x=x)


def _merkle_sql(levels: int = 8, upper: int = 3) -> str:
    """Trees of up to 8^levels leaves a language and 8^upper languages, level by level."""
    def part(v):
        return f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')"

    def leaf(text):
        return "sha256(" + " || ".join(part(text if c == "text" else c) for c in LEAF_COLUMNS) + ")"

    ctes = [_CRC_TABLE, f"""
r AS (SELECT row_number() OVER () AS rid, * FROM documents),
l AS (SELECT rid, doc_id, lang, {leaf("text")} AS leaf,
             CASE WHEN doc_id IS NOT NULL AND {crc_sql("CAST(doc_id AS VARCHAR)")} % 3 = 0
                  THEN {leaf(f"translate(text, '{_UPPER_ABC}', '{_LOWER_ABC}')")} ELSE {leaf("text")} END AS seen FROM r, crc_table),
a0 AS (SELECT rid, doc_id, lang, seen, leaf AS d,
              row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l)"""]
    for k in range(1, levels + 1):
        ctes.append(f"""
a{k} AS (SELECT lang, i // 8 AS i, list(d ORDER BY i) AS kids, sha256(string_agg(d, '' ORDER BY i)) AS d
        FROM a{k - 1} WHERE lang IN (SELECT lang FROM a{k - 1} GROUP BY lang HAVING count(*) > 1)
           OR lang IS NULL AND (SELECT count(*) FROM a{k - 1} WHERE lang IS NULL) > 1 GROUP BY lang, i // 8)""")
    tops = " UNION ALL ".join(f"SELECT lang, {k} AS k, i, d FROM a{k}" for k in range(levels + 1))
    ctes.append(f"""
s AS (SELECT lang, arg_max(d, k) AS d FROM ({tops}) GROUP BY lang),
b0 AS (SELECT lang, d, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM s)""")
    for k in range(1, upper + 1):
        ctes.append(f"""
b{k} AS (SELECT i // 8 AS i, list(d ORDER BY i) AS kids, sha256(string_agg(d, '' ORDER BY i)) AS d
        FROM b{k - 1} WHERE (SELECT count(*) FROM b{k - 1}) > 1 GROUP BY i // 8)""")
    roots = " UNION ALL ".join(f"SELECT {k} AS k, d FROM b{k}" for k in range(upper + 1))
    ctes.append(f"\nroot AS (SELECT arg_max(d, k) AS root FROM ({roots}))")
    join, n, cols, fold = "", 0, [], "a0.seen"
    for name, i, k in [("a", "a0.i", k) for k in range(1, levels + 1)] + [("b", "b0.i", k) for k in range(1, upper + 1)]:
        same = f" AND {name}{k}.lang IS NOT DISTINCT FROM a0.lang" if name == "a" else ""
        join += f" LEFT JOIN {name}{k} ON {name}{k}.i = {i} // {8 ** k}{same}"
        at = f"({i} // {8 ** (k - 1)} % 8)"
        left = f"array_to_string({name}{k}.kids[1:{at}], '')"
        right = f"array_to_string({name}{k}.kids[{at} + 2:], '')"
        cols.append(f"coalesce({left}, '') AS l{n}, coalesce({right}, '') AS r{n}, {name}{k}.i IS NOT NULL AS u{n}")
        n += 1
    ctes.append(f"""
p AS (SELECT a0.doc_id, a0.d AS leaf, a0.seen AS f0, b0.d AS subroot, root, {", ".join(cols)}
      FROM a0 JOIN b0 ON b0.lang IS NOT DISTINCT FROM a0.lang {join}, root)""")
    for k in range(n):
        ctes.append(f"\nf{k} AS (SELECT *, CASE WHEN u{k} THEN sha256(l{k} || f{k} || r{k}) ELSE f{k} END AS f{k + 1} FROM {'p' if k == 0 else f'f{k - 1}'})")
    proof = " || ".join(f"l{k} || r{k}" for k in range(n))
    return f"""WITH {",".join(ctes)}
SELECT doc_id, leaf, subroot, root, sha256({proof}) AS proof_sha256, f{n} AS folded_root, f{n} = root AS verified FROM f{n - 1}"""


@query("op13_merkle_manifest", _merkle_sql())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    cols = {c: F.col(c) for c in LEAF_COLUMNS}
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0       # null: not tampered
    low = cols | {"text": F.translate("text", _UPPER_ABC, _LOWER_ABC)}
    rows = docs.select("doc_id", "lang", merkle.leaf_digest(list(cols.values())).alias("leaf"),
                       F.when(tampered, merkle.leaf_digest(list(low.values()))).alias("changed"))
    proofs = merkle.prove(merkle.build(rows, "lang", "doc_id", "leaf", ["doc_id", "changed"]))
    folded = merkle.fold(F.coalesce("changed", "leaf"), F.col("path"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"),
                         folded.alias("folded_root")).withColumn("verified", F.col("folded_root") == F.col("root"))


# --- op11 --------------------------------------------------------------------

def planted_words(key, raw: bytes) -> list[bytes]:
    """The words of the contract: those of every tenth key (by crc32) from some place on repeat with a period."""
    words = raw.split()
    n = len(words)
    h = -1 if key is None else zlib.crc32(str(key).encode())
    if n and h >= 0 and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + i % p] for i in range(n - a)]
    return words


@query("op11_periodic_runs")
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.detect(table(spark, sf_dir, "documents"), words=planted_words)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", periodic.strongest(F.col("runs")))
    return best.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
                       F.expr("1000 * best.length div best.period").alias("exponent_milli"),
                       F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                       F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"), "n_words")


# --- op12 --------------------------------------------------------------------

@query("op12_pii")
def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents"))

    def count(kind):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("findings", lambda f: f["kind"] != "context")
    return found.select("doc_id", *[count(k) for k in pii.KINDS], F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
                        spans_text(F.col("findings")).alias("spans"))
