"""Operator 12: base rules against the regular expressions, bootstrap against a plain version."""
import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from skein.llm import pii
from skein.llm.bytesops import text_arrays
from skein.llm.queries import op12_pii

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def good(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(x) <= 255 for x in s.split("."))
    if kind == "card":
        return 12 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base(text):
    found = [(m.start(), i, m.end()) for i, (k, p) in enumerate(RULES.items()) for m in re.finditer(p, text or "") if good(k, m[0])]
    return [(pii.KINDS[k], a, z) for a, k, z in sorted(found)]


def soup(rnd, n):
    parts = ["a.b", "@", "@x", ".com", "é", "..", ".", " ", "  ", "-", "1", "12", "255", "256", "300.1.2.3", "1.2.3.4", "4111 1111 1111 1111",
             "4111-1111-1111-1111", "79927398713", "+1 (555) 010-9999", "+", "+4", "(0)", "\n", "0" * 17, "%+-", "user@mail.example.org", "3530111333300000 ", "_", "x"]
    return "".join(rnd.choice(parts) for _ in range(n))


@pytest.mark.parametrize("seed", range(8))
def test_base_rules_equal_regular_expressions(seed):
    rnd = random.Random(seed)
    texts = [soup(rnd, rnd.randrange(0, 25)) for _ in range(400)] + ["", "@", "a@b.c@d.e", "1.2.3.4.5.6.7.8.9", "+12", "+1 2", "+1222333444 ", "é+123456789é"]
    data, off = text_arrays(pa.array(texts))
    got = defaultdict(list)
    for a, k, z in pii.base_findings(data.tobytes(), data, off):
        r = int(np.searchsorted(off, a, "right")) - 1
        while off[r + 1] == off[r]:
            r -= 1
        raw = texts[r].encode()
        got[r].append((pii.KINDS[k], len(raw[:a - off[r]].decode()), len(raw[:z - off[r]].decode())))
    for r, t in enumerate(texts):
        assert got[r] == base(t), t


def test_long_runs_take_linear_time():
    import time
    t = ["x" * 400_000, "9" * 400_000, "1." * 200_000, "+1" * 200_000, "@" * 200_000, "a@b." * 100_000, "1 " * 200_000, "+ 1-" * 100_000]
    start = time.time()
    data, off = text_arrays(pa.array(t))
    found = pii.base_findings(data.tobytes(), data, off)
    pii.slots(data.tobytes(), data, off, found)
    assert time.time() - start < 20


def corpus(seed=1):
    """Seeds and unseen identifiers behind telling words; numbers behind words that tell nothing."""
    rnd = random.Random(seed)
    rows = []
    for i in range(160):
        phone = f"+1 (555) {rnd.randrange(100, 999)}-{i + 1000}"
        rows.append(f"{rnd.choice(['So', 'Then'])} please call me {phone} today or w{rnd.randrange(50)}")
        rows.append(f"order number {rnd.randrange(10 ** 6, 10 ** 7)}{i} was sent w{rnd.randrange(50)} on {rnd.randrange(10 ** 5)}{i}")
        if i % 8 == 0:
            rows.append(f"w{i} call me 555-{rnd.randrange(100, 999)}-{i + 1000} tomorrow")
        if i % 16 == 0:
            rows.append(f"write to user{i}@example.org, thanks")
    rnd.shuffle(rows)
    return list(enumerate(rows))


def brute(rows, z=3.0, least=0.5, rounds=5):
    """Context spans by row, with plain dictionaries."""
    places, edges, seed = [], defaultdict(set), set()
    for i, t in rows:
        data, off = text_arrays(pa.array([t]))
        raw = data.tobytes()
        for a, e, s in pii.slots(raw, data, off, pii.base_findings(raw, data, off)):
            v = "".join(c for c in raw[a:e].decode().lower() if c.isalnum() or c == "@")
            ps = pii._words_around(raw, 0, len(raw), a, e)
            places.append((i, len(raw[:a].decode()), len(raw[:e].decode()), s, ps))
            seed |= {v} if s else set()
            for p in ps:
                edges[p].add(v)
    ground = sum(v in seed for vs in edges.values() for v in vs) / sum(map(len, edges.values()))
    rel, accepted = defaultdict(float, dict.fromkeys(seed, 1.0)), {}
    for _ in range(rounds):
        new = {}
        for p, vs in edges.items():
            n, share = len(vs), round(sum(rel[v] for v in vs), 9) / len(vs)
            low = (share + z * z / 2 / n - z * (share * (1 - share) / n + z * z / 4 / n / n) ** .5) / (1 + z * z / n)
            if low >= max(least, ground) and low > ground:
                new[p] = low
        if set(new) == set(accepted):
            break
        accepted = new
        for v in {v for vs in edges.values() for v in vs} - seed:
            miss = 1.0
            for p, c in accepted.items():
                miss *= 1 - c if v in edges[p] else 1
            rel[v] = 1 - miss
    out = defaultdict(set)
    for i, a, e, s, ps in places:
        if not s and any(p in accepted for p in ps):
            out[i].add((a, e))
    return out, accepted


def write(spark, tmp, rows, parts):
    df = spark.createDataFrame([(k, t, "x", 1, 2.0) for k, t in rows], "doc_id long, text string, k string, rid int, base double")
    df.repartition(parts).write.mode("overwrite").parquet(f"{tmp}/documents.parquet")


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_patterns_discover_unseen_identifiers(spark, tmpdir_path, parts):
    rows = corpus()
    want, accepted = brute(rows)
    assert any("call me" in p for p in accepted) and not any("number" in p for p in accepted)
    write(spark, tmpdir_path, rows, parts)
    got = {r["doc_id"]: r for r in op12_pii(spark, tmpdir_path).collect()}
    texts = dict(rows)
    for i, t in rows:
        spans_ = sorted([(a, pii.KINDS.index(k), z) for k, a, z in base(t)] + [(a, 4, z) for a, z in want[i]])
        assert got[i]["spans"] == ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans_), t
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{z}" for k, a, z in base(t)).encode()).hexdigest()
    extra = {texts[i][a:z] for i, v in want.items() for a, z in v}
    assert len(extra) == 20 and all(x.startswith("555-") for x in extra)
    assert all(not want[i] for i, t in rows if t.startswith("order"))


def test_edges(spark, tmpdir_path):
    rows = [(None, "a@b.cc"), (1, None), (2, ""), (3, " \n "), (4, "é 1.2.3.4"), (4, "é 1.2.3.4"), (4, "other +1 555 010 9999"),
            (5, "x" * 4000), (6, "12345 " * 3000), (7, "1" * 3000)]
    write(spark, tmpdir_path, rows, 3)
    got = sorted(map(tuple, op12_pii(spark, tmpdir_path).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "spans").collect()), key=repr)
    count = lambda t: [sum(k == x for x, _, _ in base(t)) for k in pii.KINDS[:4]]
    assert got == sorted(((k, *count(t), ",".join(f"{x}:{a}:{z}" for x, a, z in base(t))) for k, t in rows), key=repr)
    assert pii.find(spark.createDataFrame([], "doc_id long, text string")).collect() == []
