"""BPE encoding against merges applied one after the other, and exact round trips."""
import random

import pytest
from pyspark.sql import functions as F

from skein.operators import bpe
from skein.operators import tokens as T


def one_after_the_other(word, merges):
    s = list(word)
    for a, b in merges:
        out = []
        for x in s:
            if out and out[-1] == a and x == b and not isinstance(out[-1], Done):
                out[-1] = Done(a + b)
            else:
                out.append(x)
        s = [str(x) for x in out]
    return s


class Done(str):
    """A symbol made in this pass, which takes no part in it again."""


def ranks_of(merges):
    out = {}
    for i, m in enumerate(merges):
        out.setdefault(m, []).append(i)
    return out


@pytest.mark.parametrize("seed", range(5))
def test_merge_word_equals_merges_in_order(seed):
    rnd = random.Random(seed)
    symbols, merges = list("abc"), []
    for _ in range(25):                                                 # pairs may come again, symbols be made twice
        pair = (rnd.choice(symbols), rnd.choice(symbols))
        merges.append(pair)
        symbols.append("".join(pair))
    for _ in range(300):
        word = "".join(rnd.choice("abcd" if rnd.random() < .1 else "abc") for _ in range(rnd.randrange(0, 40)))
        got = bpe.merge_word(word, ranks_of(merges))
        assert got == one_after_the_other(word, merges), (word, merges)
        assert "".join(got) == word


def test_long_word_is_not_quadratic():
    import time
    merges = [("a", "a"), ("aa", "aa"), ("aaaa", "aaaa")]
    t = time.time()
    assert len(bpe.merge_word("a" * 200_000, ranks_of(merges))) == 25_000 and time.time() - t < 10


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_encode_round_trip_and_naive_ids(spark, parts):
    rnd = random.Random(1)
    texts = ["", None, "  lead and  trail \n\t", "naïve café 42", "word " * 3000]
    texts += [" ".join(rnd.choice(["low", "lower", "lowest", "new", "newer", "wide", "wider", "7", "!?"]) for _ in range(30)) for _ in range(60)]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, ids string").repartition(parts)
    merges, vocab = bpe.train_bpe(df, 30)
    steps = [(r["left"], r["right"]) for r in merges.orderBy("rank").collect()]
    number = {r["token"]: r["id"] for r in vocab.collect()}
    assert sorted(number.values()) == list(range(T.FIRST_WORD_ID, T.FIRST_WORD_ID + len(number)))
    enc = bpe.encode_bpe(df, ["id"], merges, vocab, "text", T.PIECE_PATTERN)
    got = {r["id"]: list(r["ids"]) for r in enc.collect()}
    words = {r["id"]: r["w"] for r in df.select("id", T.split_tokens("text", T.PIECE_PATTERN).alias("w")).collect()}
    for i, ws in words.items():
        assert got[i] == [number[s] for w in ws for s in one_after_the_other(w, steps)]
    back = {r["id"]: r["decoded"] for r in T.decode(enc, ["id"], vocab).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    # a text of another corpus: characters that were never seen are unknown
    other = spark.createDataFrame([(1, "Ж low")], "id long, text string")
    ids = bpe.encode_bpe(other, ["id"], merges, vocab, "text", T.PIECE_PATTERN).first()["ids"]
    assert ids[0] == T.UNK_ID and T.UNK_ID not in ids[1:]


def test_no_merges_and_empty_table(spark):
    df = spark.createDataFrame([(1, "ab ab")], "id long, text string")
    none = spark.createDataFrame([], "rank int, left string, right string, n long")
    vocab = bpe.bpe_vocab(df, none, "text", T.PIECE_PATTERN)
    assert bpe.encode_bpe(df, ["id"], none, vocab, "text", T.PIECE_PATTERN).select(F.size("ids")).first()[0] == 5
    assert bpe.encode_bpe(df.limit(0), ["id"], none, vocab).collect() == []
