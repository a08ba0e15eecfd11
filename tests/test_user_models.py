"""U4 and T8 with a real scorer and a public tokenizer file."""
import math
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from skein.operators import infer as U

TEXTS = [None, "", "a", "Hello, World\n", "Hello", "naïve 你好 🙂 text", "z" * 5000, "Hello", "<|endoftext|> x", "a\tb\r\nC"]


def _df(spark, parts=3):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string").repartition(parts)


def _fold(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c if "a" <= c <= "z" else " " for c in t or "")


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_bigram_scores_equal_a_plain_model(spark, parts):
    df = _df(spark, parts)
    count = Counter(p for t in TEXTS for p in zip(_fold(t), _fold(t)[1:], strict=False))
    first = Counter()
    for (a, _), n in count.items():
        first[a] += n
    got = U.batch_infer(df, U.bigram_scorer_factory(U.bigram_costs(df)), "text", ["id"], "cost").collect()
    want = {i: sum(round(1000 * math.log((first[a] + 27) / (count[a, b] + 1))) for a, b in zip(_fold(t), _fold(t)[1:], strict=False))
            for i, t in enumerate(TEXTS)}
    assert {r["id"]: int(r["cost"]) for r in got} == want
    assert U.bigram_costs(df.limit(0)) == [round(1000 * math.log(27))] * 729


def test_public_tokenizer_equals_whole_text_encoding(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    ids = U.tokenize_with(_df(spark), U.json_tokenizer_factory(spark, path), "text")
    got = {r["id"]: (list(r["ids"]), r["decoded"]) for r in U.decode_with(ids, U.json_decoder_factory(spark, path), "ids").collect()}
    assert got == {i: (t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in enumerate(TEXTS)}
    empty = U.tokenize_with(_df(spark).limit(0), U.json_tokenizer_factory(spark, path), "text")
    assert empty.count() == 0


def test_ranks_give_the_ids_of_the_same_vocabulary(spark):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    enc, dec = U.rank_tokenizer_factory(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for parts in (1, 8, 64):
        out = U.decode_with(U.tokenize_with(_df(spark, parts), enc, "text"), dec, "ids")
        assert out.columns == ["id", "text", "ids", "decoded"]
        assert {r["id"]: (list(r["ids"]), r["decoded"]) for r in out.collect()} == \
            {i: (t.encode(x or "", add_special_tokens=False).ids, x or "") for i, x in enumerate(TEXTS)}


def test_slices_keep_order_and_bound():
    texts = ["ab", None, "cdef", "g" * 9, "h"]
    parts = list(U._slices(pa.array(texts), 5))
    assert [x for _, p in parts for x in p] == [x or "" for x in texts]
    assert [lo for lo, _ in parts] == [0, 2, 3, 4] and all(len(p) == 1 or sum(map(len, p)) <= 5 for _, p in parts)
    assert list(U._slices(pa.array([], pa.string()))) == []
