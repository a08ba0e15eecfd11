"""Operator 11 against a plain search for every period."""
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.llm import periodic
from skein.llm.queries import op11_periodic_runs


def brute(w):
    found = {}
    n = len(w)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)                   # the smallest period comes first
            i = j
    return sorted((a, n, q) for (a, n), q in found.items())


def texts(seed, n=60):
    rnd = random.Random(seed)
    out = []
    for _ in range(n):
        w = []
        for _ in range(rnd.randrange(1, 6)):
            kind = rnd.randrange(4)
            block = [rnd.choice("abcdefgh"[:rnd.choice([1, 2, 3, 8])]) for _ in range(rnd.randrange(1, 14))]
            if kind < 3:
                block = block * rnd.randrange(1, 9)
                block = block[rnd.randrange(len(block)):] if rnd.random() < .3 else block
            if rnd.random() < .2:
                block[rnd.randrange(len(block)):] = ["z"]
            w += block * rnd.choice([1, 1, 1, 4])
        out.append([x.encode() for x in w])
    return out


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return [c.encode() for c in b[:n]]


def thue_morse(n):
    return [b"ab"[bin(i).count("1") % 2:][:1] for i in range(n)]


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_brute_force(seed):
    ts = texts(seed) + [[], [b"a"], [b"a"] * 5, [b"a"] * 6, [b"a"] * 333, [b"a", b"b"] * 100, [b"a", b"a", b"b"] * 50,
                        fibonacci(300), thue_morse(512), thue_morse(256) * 4, fibonacci(34) * 7 + fibonacci(21) * 9]
    for t, got in zip(ts, periodic.find_runs(ts), strict=True):
        assert got == brute(t), t


@pytest.mark.parametrize("piece", [1, 2, 5, 17, 64, 1000])
def test_appending_in_pieces_changes_nothing(piece):
    for t in [*texts(11, 12), [b"a"] * 130, fibonacci(200), (list(map(bytes, zip(range(97)))) * 5)]:
        catch, number = periodic.Catchers(), {}
        ids = np.array([number.setdefault(w, len(number)) for w in t], np.int64)
        for lo in range(0, len(ids), piece):
            catch.append(ids[lo:lo + piece])
            if lo == 5 * piece:
                assert catch.runs() == brute(t[:lo + piece])          # also while the text still grows
        assert catch.runs() == brute(t)


def test_runs_across_pieces_of_a_long_text(monkeypatch):
    monkeypatch.setattr(periodic, "PIECE", 50)
    ts = [t * 3 for t in texts(5, 20)]
    for t, got in zip(ts, periodic.find_runs(ts), strict=True):
        assert got == brute(t)
    long = [b"w%d" % (i % 30_011) for i in range(130_000)]             # period 30,011, 130,000 words
    monkeypatch.undo()
    assert periodic.find_runs([long, [b"x"] * 200_000]) == [[(0, 130_000, 30_011)], [(0, 200_000, 1)]]


def reference(key, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(w), zlib.crc32(str(key).encode()) if key is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w)
    gone = {i for a, m, q in runs for i in range(a + q, a + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None,) * 3
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (key, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            sha("".join(f"{a},{m},{q}\n" for a, m, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)), n)


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_query_equals_brute_force(spark, tmpdir_path, parts):
    rows = [(i, " ".join(x.decode() for x in t)) for i, t in enumerate(texts(3, 120))]
    rows += [(500 + i, f"é {i} \t word " * (i % 9)) for i in range(60)]
    rows += [(None, "a a a a a a a"), (900, None), (901, ""), (902, " \n\t "), (903, "b\x1cb b b b b b b"), (903, "c " * 9),
             (903, "c " * 9), (904, "long " * 3000), (905, "x" * 100_000)]
    df = spark.createDataFrame([(k, t, 1, "s", "x", 2) for k, t in rows], "doc_id long, text string, runs int, best string, collapsed string, start int")
    df.repartition(parts).write.mode("overwrite").parquet(f"{tmpdir_path}/documents.parquet")
    got = op11_periodic_runs(spark, tmpdir_path)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted((reference(k, t) for k, t in rows), key=repr)


def test_empty_table(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert periodic.detect(empty).collect() == []
    one = periodic.detect(spark.createDataFrame([("k", "a b a b a b a b c")], "name string, body string"), "name", "body")
    assert one.select("name", F.col("runs")[0]["period"], "collapsed").first() == ("k", 2, "a b c")
