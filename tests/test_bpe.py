"""T7 BPE merges against a brute-force implementation."""
import re
from collections import Counter

from skein.operators.bpe import CLOSE, OPEN, apply_merge, learn_bpe, safe_prefix


def _brute(texts, n):
    words = Counter(t for s in texts for t in re.findall(r"[^\W\d_]+|\d+|[^\w\s]+|_+", s))
    syms = {w: list(w) for w in words}
    out = []
    for i in range(n):
        pairs = Counter()
        for w, c in words.items():
            s = syms[w]
            for a, b in zip(s, s[1:]):
                pairs[(a, b)] += c
        if not pairs:
            break
        (a, b), cnt = sorted(pairs.items(), key=lambda kv: (-kv[1], kv[0][0].encode(), kv[0][1].encode()))[0]
        out.append((i, a, b, cnt))
        for w in syms:
            s, res = syms[w], []
            for x in s:
                if res and res[-1] == a and x == b:
                    res[-1] = a + b
                else:
                    res.append(x)
            syms[w] = res
    return out


def test_bpe_matches_brute_force(spark):
    texts = ["low lower lowest newer wider", "the the then there their", "aaa aaaa banana bandana 42 4242"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tuple(r) for r in learn_bpe(df, 12).orderBy("rank").collect()]
    assert got == _brute(texts, 12)


def _marked(symbols):
    return "".join(OPEN + x + CLOSE for x in symbols)


def test_apply_merge_left_to_right(spark):
    df = spark.createDataFrame([(_marked("aaab"),), (_marked(["a$", "\\E", "a$", "\\E"]),)], "s string")
    got = [r.m for r in df.select(apply_merge(df.s, "a", "a").alias("m")).collect()]
    assert got[0] == _marked(["aa", "a", "b"])
    got = [r.m for r in df.select(apply_merge(df.s, "a$", "\\E").alias("m")).collect()]
    assert got[1] == _marked(["a$\\E", "a$\\E"])             # nothing is read as a pattern


def test_safe_prefix_stops_at_shared_symbols_and_ties():
    assert safe_prefix([("a", "b", 9), ("c", "d", 8), ("b", "x", 7), ("e", "f", 6)], True) == 2
    assert safe_prefix([("a", "b", 9), ("c", "d", 7), ("b", "x", 7)], True) == 1     # a tie with a shared symbol
    assert safe_prefix([("a", "b", 9), ("c", "d", 7), ("e", "f", 7)], False) == 1    # the tie may go on
    assert safe_prefix([("a", "b", 9), ("c", "d", 7), ("e", "f", 7)], True) == 3
    assert safe_prefix([], True) == 0 and safe_prefix([("a", "a", 2)], False) == 1


def test_many_merges_match_brute_force(spark):
    import random
    rnd = random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 9))) for _ in range(60)) for _ in range(5)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [tuple(r) for r in learn_bpe(df, 40).orderBy("rank").collect()]
    assert got == _brute(texts, 40)
