"""Vector, URL and packing operators and the pipeline against brute force."""
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import kdsearch, neardup, packing, urls
from skein.llm import queries as Q
from skein.llm.scratch import components

SCHEMA = "vec_id long, embedding array<float>, label int, id long, score double, unit string"
ODD = [(1000, None, 1), (1020, [1.0, float("nan")] * 4, 1), (1040, [0.5, None] * 4, 2), (1060, [float("inf")] * 8, 2),
       (1080, [0.0] * 8, 1), (1100, [0.25] * 8, None), (1120, [], 3)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, [float(x) if x is not None else None for x in v] if v is not None else None, y, 7, 0.1, "u")
                                  for i, v, y in rows], SCHEMA)


def random_rows(seed, n=300, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[n // 2:n // 2 + 40] = x[0]                                    # a very common vector
    x[10:20] = x[9] * rng.uniform(0.99, 1.01, (10, 1)).astype(np.float32)
    return [(i, x[i].tolist(), int(i % 3)) for i in range(n)]


def usable(v):
    return v is not None and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("unit_rows", [40, 4096])
def test_topk_equals_brute_force(spark, unit_rows):
    rows = random_rows(3) + ODD
    got = defaultdict(list)
    for r in kdsearch.top_k(vectors(spark, rows), F.col("vec_id") % 20 == 0, k=7, unit_rows=unit_rows).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    ints = {i: [int(np.floor(64 * float(np.float32(x)))) for x in v] + [0] * (8 - len(v)) for i, v, _ in rows if usable(v)}
    for q in (i for i in ints if i % 20 == 0):
        s = sorted((-sum(a * b for a, b in zip(ints[q], ints[c])), c) for c in ints if c != q)[:7]
        assert sorted(got.pop(q)) == [(k + 1, c, -x) for k, (x, c) in enumerate(s)]
    assert not got


def test_topk_few_and_no_rows(spark):
    df = vectors(spark, [(0, [1.0, 2.0], 1), (3, [1.0, 1.0], 1), (20, [1.0], 1)])
    out = sorted(tuple(r) for r in kdsearch.top_k(df, F.col("vec_id") % 20 == 0).collect())
    assert out == [(0, 1, 3, 64 * 64 * 3), (0, 2, 20, 64 * 64), (20, 1, 0, 64 * 64), (20, 2, 3, 64 * 64)]
    assert kdsearch.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_topk_repeated_rows_and_large_values(spark):
    df = vectors(spark, [(20, [1e6, -2e6], 1), (20, [1e6, -2e6], 1), (1, [3e6, 5e6], 1), (1, [3e6, 5e6], 1)])
    got = [tuple(r) for r in kdsearch.top_k(df, F.col("vec_id") % 20 == 0).collect()]
    s = 64 * 64 * (3 * 10 ** 12 - 10 * 10 ** 12)
    assert sorted(got) == [(20, 1, 1, s), (20, 2, 1, s)]


def brute_links(rows, threshold=0.98):
    ok = {i: (np.array(v, float) / np.linalg.norm(np.array(v, float)), y) for i, v, y in rows
          if usable(v) and any(v) and y is not None}
    links, root = defaultdict(set), {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in ok:
        for b in ok:
            if a < b and ok[a][1] == ok[b][1] and len(ok[a][0]) == len(ok[b][0]) and ok[a][0] @ ok[b][0] >= threshold:
                links[a].add(b)
                links[b].add(a)
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(links[i]), find(i), find(i) == i) for i in root}


def test_neardup_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    rows = random_rows(5)
    base = rng.normal(size=(30, 8))
    for k in range(200):                                             # clusters around the threshold
        v = base[k % 30] / np.linalg.norm(base[k % 30]) + rng.normal(0, 0.045, 8)
        rows.append((400 + k, v.astype(np.float32).tolist(), int(k % 30 % 3)))
    got = {r["vec_id"]: tuple(r)[1:] for r in neardup.link(vectors(spark, rows + ODD)).collect()}
    want = brute_links([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], y)
                        for i, v, y in rows + ODD])
    assert set(got) == set(want)
    found, true = sum(x[0] for x in got.values()), sum(x[0] for x in want.values())
    assert true > 500 and 0.98 * true <= found <= true
    assert sum(got[i] == want[i] for i in want) >= 0.97 * len(want)
    for i, _, _ in ODD:
        assert got[i] == (0, i, True)


def test_neardup_blocks_agree(spark, monkeypatch):
    """Many small blocks give what one block gives."""
    rows = random_rows(5)
    one = {tuple(r) for r in neardup.link(vectors(spark, rows)).collect()}
    monkeypatch.setattr(neardup, "BLOCK", 16)
    assert {tuple(r) for r in neardup.link(vectors(spark, rows)).collect()} == one
    assert neardup.link(vectors(spark, rows).limit(0)).count() == 0


def test_needed_count_keeps_recall():
    assert neardup.needed_count(0.0) == neardup.PROJECTIONS
    c = neardup.needed_count(0.999)
    rng = np.random.default_rng(0)
    hits = (np.abs(rng.normal(size=(20000, neardup.PROJECTIONS))) <= neardup.WINDOW).sum(axis=1)
    assert (hits >= c).mean() > 0.998


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(200, 200)] + [(300, 301), (301, 300)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 300: 300, 301: 300}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- urls ------------------------------------------------------------------

def brute_url(url, rules=urls.RULES):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        end = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = rest[:end].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        tail = rest[end:]
        path = tail[:min([tail.index(c) for c in "?#" if c in tail], default=len(tail))]
    hits = [(len(h + p), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(hits, default=None)
    return host, path, best and best[1], best[2] if best else urls.DEFAULT_VERDICT


def test_urls_equal_brute_force(spark):
    cases = [None, "", "no scheme", "http://", "http://ORG/", "https://a.example.org/es/x?y#z", "http://example.org/en/17",
             "http://example.org/en/2", "http://xexample.org/es/", "http://a..org/", "http://org", "http://org?x=/",
             "http://É.com/fr/", "a://b://org/", "http://x.com/de/#a?b", "http://x.com/DE/", "http://user@x.com:80/fr/1",
             "http://.com/fr/", "http://com/fr/" + "p" * 50_000, "http://" + "a." * 5000 + "com/de/", "http://x.org\n/es/"]
    rows = [(i, u, "h", "hostx") for i, u in enumerate(cases * 2)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, digest string")
    got = urls.filter_urls(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert tuple(r)[1:] == brute_url(cases[r["page_id"] % len(cases)]), cases[r["page_id"] % len(cases)]
    assert urls.filter_urls(df.limit(0)).count() == 0
    assert {r["verdict"] for r in urls.filter_urls(df, rules=[]).collect()} == {"allow"}
    with pytest.raises(ValueError):
        urls.filter_urls(df, rules=[("maybe", "org", "/")])


# --- packing ---------------------------------------------------------------

def test_best_cuts_are_optimal():
    rnd = random.Random(3)
    for _ in range(30):
        pos = np.cumsum([rnd.randrange(1, 12) for _ in range(40)])
        pen = np.array([rnd.choice([0, 3, 9]) for _ in pos])
        size = 16
        xs, ps = [0, *pos.tolist()], [0, *pen.tolist()]
        best = [0] + [10 ** 9] * 40
        for j in range(1, 41):
            best[j] = min(best[i] + size - (xs[j] - xs[i]) + ps[j] for i in range(j) if xs[j] - xs[i] <= size)
        cuts = packing.best_cuts(pos, pen, size)
        cost = sum(size - (b - a) + ps[xs.index(b)] for a, b in zip([0, *cuts], cuts))
        assert cost == best[-1] and cuts[-1] == pos[-1] and all(b - a <= size for a, b in zip([0, *cuts], cuts))


def check_packing(rows, pieces, size):
    """Every id in exactly one piece, windows gapless and at most ``size``; returns padding share."""
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(Q.vocabulary())
    want = sorted((k is not None, k, tok.encode(t or "", add_special_tokens=False).ids + [2]) for k, t in rows)
    by = defaultdict(list)
    windows = defaultdict(list)
    for p in pieces:
        by[p["doc_id"]].append(p)
        windows[p["sequence_id"]].append((p["offset"], p["length"]))
    total = pad = 0
    for w in windows.values():
        w.sort()
        assert [a for a, _ in w] == [0, *np.cumsum([n for _, n in w])[:-1].tolist()]
        n = sum(x for _, x in w)
        assert 0 < n <= size
        total += n
        pad += 0 if n & (n - 1) == 0 else size - n
    got = []
    for k, ps in by.items():
        ps.sort(key=lambda p: (p["sequence_id"], p["offset"]))
        ids: list = []
        for p in ps:
            if p["start"] == 0:
                ids = []
            assert p["start"] == len(ids)
            x = np.frombuffer(p["ids"], "<u4").tolist()
            assert len(x) == p["length"]
            ids += x
            if len(ids) == p["doc_tokens"]:
                got.append((k is not None, k, ids))
    assert sorted(got) == want
    return pad / max(total, 1)


def test_packing_round_trip(spark):
    rnd = random.Random(7)
    words = ["the", "Été", "don't", "it's", "x1y2", "…", "naïve.", "end.", "¿Qué?", "日本", "a,b;c", "<|endoftext|>", "ÀB'S"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([0, 1, 5, 60, 400])))) for i in range(150)]
    rows += [(None, "null key."), (900, None), (901, ""), (902, "same"), (902, "same"), (903, "long " * 9000),
             (904, "x" * 30_000), (905, "\x1c \u2028 ﬁ İ Σς")]
    df = spark.createDataFrame([(k, t, 1, "z") for k, t in rows], "doc_id long, text string, length int, ids string").repartition(3)
    pieces = packing.pack(df, Q.vocabulary(), size=256).collect()
    check_packing(rows, pieces, 256)
    assert packing.pack(df.limit(0), Q.vocabulary()).count() == 0
    with pytest.raises(ValueError):
        packing.pack(df, Q.vocabulary(), size=100)


def test_packing_little_padding_and_flushes(spark, monkeypatch):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in df.collect()]
    assert check_packing(rows, packing.pack(df, Q.vocabulary()).collect(), 4096) < 0.02
    p = packing.Packer(np.full(10, -1), 64, 0)
    out = []
    for i in range(50):                                              # early windows leave, order and tiling hold
        p.add(i, np.full(37, 1, np.int32))
        out += p.flush(False)
    out += p.flush(True)
    assert sum(x[2] for x in out) == 50 * 37 and [x[0] for x in out] == sorted(x[0] for x in out)


# --- queries and pipeline --------------------------------------------------

def test_language_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = Q.QUERIES["op5_language_id"](spark, sf).join(
        spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_pipeline_stages_decide_row_by_row(spark):
    import corpus_pipeline as P
    a, b = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    rows = [(5, a + " end", 1), (2, a, 1), (5, b, 1), (None, a, 1), (None, "other words of their own here", 1), (7, None, 1),
            (8, "", 1), (8, "", 1), (9, b, 1)]
    docs = spark.createDataFrame([(k, t, "en", "s", 3, {"m": n}, 0.5) for k, t, n in rows],
                                 "doc_id long, text string, lang string, source string, n_chars long, _rid map<string, int>, _draw double")
    for parts in (1, 7):
        out = P.near_duplicates(spark, docs.repartition(parts), "")
        assert out.columns == docs.columns
        assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=repr) == sorted(
            [(2, a), (5, b), (None, "other words of their own here"), (7, None), (8, ""), (8, "")], key=repr)
    assert P.near_duplicates(spark, docs.limit(0), "").count() == 0
    sf = "/root/testdata/sf0.001"
    for stage in (P.secret_scan, P.mix_sources):
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.filter("doc_id = 7").first()["text"] is None
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline as P
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    junk = spark.createDataFrame([(10 ** 6, "12345 67890", None, "s", 11), (10 ** 6 + 1, None, "en", "s", 0)], docs.schema)
    start = docs.unionByName(junk)
    one = P.language(spark, start, sf)
    assert one.columns == docs.columns and {r["doc_id"] for r in one.collect()} == {r["doc_id"] for r in docs.collect()}
    two = P.near_duplicates(spark, docs, sf)
    from test_text_ops import brute_components, shingle_set
    rows = sorted(tuple(r) for r in docs.select("doc_id", "text").collect())
    root = brute_components([shingle_set(t) for _, t in rows])
    assert sorted(r["doc_id"] for r in two.collect()) == [rows[i][0] for i in range(len(rows)) if root[i] == i]
    four = P.mix_sources(spark, two, sf)
    clean = {r["doc_id"] for r in spark.read.parquet(f"{sf}/labels.parquet").filter("quality = 1 and toxic = 0").collect()}
    kept = {r["doc_id"] for r in four.collect()}
    have = clean & {r["doc_id"] for r in two.collect()}
    assert len(have & kept) >= 0.97 * len(have)
    pieces = P.run(spark, sf).collect()
    tokens = defaultdict(int)
    for p in pieces:
        tokens[p["doc_id"]] += p["length"]
    assert all(tokens[p["doc_id"]] == p["doc_tokens"] for p in pieces)
    assert [n for n, _ in P.STAGES] == ["language", "near_duplicates", "secrets", "mixing", "packing"]
