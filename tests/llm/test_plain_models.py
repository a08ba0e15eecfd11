"""Language ID and toxicity against plain versions: sets of n-grams, dictionaries of terms."""
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from skein.llm import langid, toxicity
from skein.llm.bytesops import SpanHash, lower_table, seed_table

STEMS = {"aa": ["banana", "Sábana", "labor", "ÀÉÎ", "común"], "bb": ["xoxoty", "zoxot", "qyx", "común"], "cc": ["xoxo", "banan", "tyr", "Zürich"]}


def _texts(seed, n=90):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        w = [rnd.choice(STEMS[lang]) + rnd.choice(["", "a", "ty", "s"]) for _ in range(rnd.randrange(1, 25))]
        rows.append((i, rnd.choice([" ", "  ", "\n", "-7 "]).join(w), lang))
    return rows


def _grams(text, size):
    raw = bytearray()
    for ch in text:
        b = ch.encode()
        if len(b) == 1:
            raw += ch.lower().encode() if ch.isalpha() else b" "
        else:
            raw += (ch.lower() if "À" <= ch <= "Þ" and ch != "×" else ch).encode()
    s = b" " + bytes(raw) + b" "
    out = [s[i:i + size] for i in range(len(s) - size + 1)]
    return [g for g in out if 32 not in g[1:size - 1]]


def test_language_scores_equal_sets_of_ngrams(spark):
    train, other = _texts(1), _texts(2)
    model = langid.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    n, d, total = defaultdict(Counter), defaultdict(Counter), Counter()
    for _, text, lang in train:
        for size in (3, 4):
            g = _grams(text, size)
            total[lang, size] += len(g)
            n[lang].update(g)
            d[lang].update(set(g))
    rate = {lang: {g: k / total[lang, len(g)] for g, k in c.items()} for lang, c in n.items()}
    holds = {lang: {g for g, r in c.items() if d[lang][g] >= 2 and r >= 0.25 * max(x.get(g, 0) for x in rate.values())}
             for lang, c in rate.items()}
    assert model["langs"] == sorted(holds) and any(holds["aa"] & holds["bb"])      # an n-gram of several languages
    rows = [*other, (900, "", None), (901, "12 --", None), (902, "ñandú", None), (903, "kkkk jjjj", None)]
    got = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        g = _grams(r["text"], 3) + _grams(r["text"], 4)
        share = [sum(x in holds[lang] for x in g) / max(len(g), 1) for lang in sorted(holds)]
        letters = any(c.isalpha() for c in r["text"])
        best = max(range(3), key=lambda i: (share[i], -i))
        assert r["lang_pred"] == (sorted(holds)[best] if letters else "und") and r["n_grams"] == len(g)
        assert abs(r["score"] - (share[best] if letters else 0)) < 1e-6             # the filter's false positives are corrected


def _terms(text):
    for w in re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode()):
        w = w.lower()
        yield w, 0
        for k in (4, 5):
            if len(w) > k:
                yield w[:k], k


def test_severity_equals_a_dictionary_of_terms(spark):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(240):
        toxic = i % 3 == 0
        w = [rnd.choice(["alpha", "Beta", "gammaray", "dé", "x1"]) for _ in range(rnd.randrange(5, 30))]
        for _ in range(rnd.randrange(1, 7) if toxic else 0):
            w[rnd.randrange(len(w))] = rnd.choice(["vilexx", "VILEYY", "vile"])
        rows.append((i, rnd.choice([" ", ", ", "\n"]).join(w)))
        labels.append((i, int(toxic)))
    rows += [(900, None), (901, ""), (902, "!!"), (903, "vilexx " * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    hasher, table = SpanHash(), seed_table(lower_table())

    def key(term, k):
        data = np.frombuffer(term, np.uint8)
        return int(hasher.of(hasher.sums(data, table), np.array([0]), np.array([len(data)]))[0] ^ np.uint64(k))
    weight = dict(zip(model["keys"].tolist(), model["w"].tolist(), strict=False))
    seen = {t: weight.get(key(*t)) for t in {t for _, x in rows for t in _terms(x)}}
    assert sum(v is not None for v in seen.values()) > 5
    got = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        count = Counter(t for t in _terms(text) if seen[t] is not None)
        s = sum(seen[t] * math.log1p(k) for t, k in count.items())
        above = [1 - 1 / (1 + math.exp(-max(-40, min(40, c - s)))) for c in model["cuts"]]
        mass = [1 - above[0], *[a - b for a, b in zip(above, above[1:], strict=False)], above[-1]]
        assert abs(got[i]["severity"] - sum(above)) < 1e-6 and abs(got[i]["p_toxic"] - above[0]) < 1e-6
        assert mass[got[i]["grade"]] > max(mass) - 1e-6
        if abs(above[0] - model["threshold"]) > 1e-6:
            assert got[i]["toxic"] == (above[0] >= model["threshold"] and any(True for _ in _terms(text)))
