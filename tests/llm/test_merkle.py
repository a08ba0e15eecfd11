"""Operator 13 against a plain tree over small tables with edge rows."""
import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from skein.llm import merkle
from skein.llm.queries import LEAF_COLUMNS, op13_merkle_manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(x):
    return hashlib.sha256(x.encode()).hexdigest()


def plain_leaf(row):
    return H("".join("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in LEAF_COLUMNS))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for level in levels[:-1]:
        lo = i // 8 * 8
        out.append(("".join(level[lo:i]), "".join(level[i + 1:lo + 8])))
        i //= 8
    return out


def brute(rows):
    """(doc_id, leaf, subroot, root, path) of every row."""
    by = defaultdict(list)
    for r in rows:
        by[r["lang"]].append((r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r), r))
    langs = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(by[g], key=lambda x: x[:3])]) for g in langs}
    top = tree([trees[g][-1][0] for g in langs])
    return [(x[3], x[2], trees[g][-1][0], top[-1][0], siblings(trees[g], i) + siblings(top, j))
            for j, g in enumerate(langs) for i, x in enumerate(sorted(by[g], key=lambda x: x[:3]))]


def expected(rows):
    out = []
    for r, leaf, subroot, root, path in brute(rows):
        cur = leaf
        if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0 and r["text"] is not None:
            low = "".join(c.lower() if "A" <= c <= "Z" else c for c in r["text"])
            cur = plain_leaf(r | {"text": low})
        for a, b in path:
            cur = H(a + cur + b)
        out.append((r["doc_id"], leaf, subroot, root, H("".join(a + b for a, b in path)), cur, cur == root))
    return out


def rows_of(n, langs, seed=1):
    rnd = random.Random(seed)
    return [{"doc_id": i, "text": rnd.choice(["Abc é", "", None, "low", "Ünï CODE"]) if rnd.random() < .5 else f"Text {i}",
             "lang": rnd.choice(langs), "source": rnd.choice(["s", None]), "n_chars": rnd.choice([5, None, -1])}
            for i in range(n)]


def run(spark, tmp, rows, parts=3, extra=False):
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA).repartition(parts)
    if extra:
        for c in ("part", "h", "rank", "leaf", "path", "g", "k", "idx", "digest", "children", "_u", "_at", "changed"):
            df = df.withColumn(c, F.lit("x"))
    df.write.mode("overwrite").parquet(f"{tmp}/documents.parquet")
    out = op13_merkle_manifest(spark, tmp)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, out.collect()), key=repr)


@pytest.mark.parametrize("n, langs, parts", [(200, ["a", "b", "é", "Z", None], 4), (65, [None], 1),
                                             (40, list("abcdefghijk"), 64), (1, ["x"], 2), (8, ["x"], 3), (9, ["x", "y"], 3)])
def test_manifest_equals_plain_tree(spark, tmpdir_path, n, langs, parts):
    rows = rows_of(n, langs)
    got = run(spark, tmpdir_path, rows, parts, extra=True)
    assert got == sorted(expected(rows), key=repr)
    changed = {r[0] for r in got if not r[6]}
    assert all(zlib.crc32(str(k).encode()) % 3 == 0 for k in changed)


def test_null_keys_ties_and_repeated_rows(spark, tmpdir_path):
    rows = rows_of(30, ["a", "b"])
    rows += [dict(rows[3]) for _ in range(40)]                                  # one row 41 times
    rows += [rows[5] | {"doc_id": None, "text": t} for t in ("A", None, "A", "b" * 100_000)]
    rows += [rows[7] | {"text": f"Other {i}"} for i in range(20)]               # one key, many texts
    assert run(spark, tmpdir_path, rows) == sorted(expected(rows), key=repr)


def test_empty_table(spark, tmpdir_path):
    assert run(spark, tmpdir_path, []) == []


def test_requested_leaves_only(spark):
    rows = rows_of(300, ["a", "b", None])
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in SCHEMA.split(", ")) for r in rows], SCHEMA)
    leaves = df.select("doc_id", "lang", merkle.leaf_digest([F.col(c) for c in LEAF_COLUMNS]).alias("leaf"))
    m = merkle.build(leaves, "lang", "doc_id", "leaf", ["doc_id"])
    got = merkle.prove(m, F.col("keep_doc_id").isin(3, 77, 150)).withColumn("folded", merkle.fold(F.col("leaf"), F.col("path")))
    want = {r["doc_id"]: (leaf, path) for r, leaf, _, _, path in brute(rows)}
    got = {r["doc_id"]: r for r in got.collect()}
    assert set(got) == {3, 77, 150}
    for k, r in got.items():
        assert (r["leaf"], [tuple(s) for s in r["path"]]) == want[k] and r["folded"] == m.root == r["root"]
    assert m.store().groupBy("digest").count().filter("count > 1").count() == 0
    # a changed leaf, and a proof of another leaf, do not give the root
    a, b = got[3], got[77]
    other = spark.createDataFrame([(H("x"), a["path"]), (a["leaf"], b["path"])], f"leaf string, path {merkle.PATH}")
    assert all(r[0] != m.root for r in other.select(merkle.fold(F.col("leaf"), F.col("path"))).collect())
