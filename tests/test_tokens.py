"""T1-T8, P8, B1-B3 edge rows and properties."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators import infer as U
from skein.operators import tokens as T


def _vocab(spark, words):
    return spark.createDataFrame([(w, i + 2, 1) for i, w in enumerate(words)], "token string, id int, n long")


def test_fit_edge_lengths(spark):
    vocab = _vocab(spark, ["a", "b"])
    rows = [(1, ""), (2, None), (3, "a b a b"), (4, "a b a b a"), (5, "zz a")]
    df = spark.createDataFrame(rows, "k int, text string")
    got = {r.k: r for r in T.tokenize(df, ["k"], vocab, "text", 4).collect()}
    assert got[1].input_ids == [0, 0, 0, 0] and got[1].labels == [-100] * 4 and got[1].attention_mask == [0] * 4
    assert got[2].input_ids == [0, 0, 0, 0] and got[2].n_tok == 0  # NULL text kept as an all-pad row
    assert got[3].input_ids == [2, 3, 2, 3] and got[3].attention_mask == [1, 1, 1, 1] and got[3].n_raw == 4
    assert got[4].input_ids == [2, 3, 2, 3] and got[4].n_raw == 5  # block_size + 1 truncated
    assert got[5].input_ids == [1, 2, 0, 0] and got[5].labels == [1, 2, -100, -100]  # unknown word


def test_genuine_eos_masked_in_reference_mode(spark):
    df = spark.createDataFrame([(1, [5, 0, 6])], "k int, ids array<int>")
    ref = T.fit(df, "ids", 5).first()
    pos = T.fit(df, "ids", 5, mask="position").first()
    assert ref.labels == [5, -100, 6, -100, -100]
    assert pos.labels == [5, 0, 6, -100, -100]


def test_vocab_ties_by_token(spark):
    df = spark.createDataFrame([("b a c a b",)], "text string")
    got = [(r.token, r.id, r.n) for r in T.build_vocab(df, "text", 2).collect()]
    assert sorted(got, key=lambda x: x[1]) == [("a", 2, 2), ("b", 3, 2)]


@settings(max_examples=25, deadline=None)
@given(st.text(max_size=40))
def test_byte_roundtrip(spark, s):
    df = spark.createDataFrame([(s,)], "text string")
    r = df.select(T.byte_ids("text").alias("ids")).select("ids", T.decode_bytes("ids").alias("d")).first()
    assert r.ids == [b + 2 for b in s.encode("utf-8")]
    assert r.d == s


def test_byte_prefix_truncation(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, "")], "k int, text string")
    got = {r.k: r for r in T.tokenize_bytes(df, ["k"], "text", 4).collect()}
    assert got[1].input_ids == [b + 2 for b in "héllo".encode()[:4]] and got[1].n_raw == len("héllo wörld".encode())
    assert got[2].input_ids == [0, 0, 0, 0]


def test_pad_batch_cap(spark):
    df = spark.createDataFrame([(0, [2, 3]), (0, [2, 3, 4, 5, 6]), (1, [7])], "b int, ids array<int>")
    got = sorted((r.b, r.batch_len, r.input_ids) for r in T.pad_batch(df, "b", "ids", cap=4).collect())
    assert got == [(0, 4, [2, 3, 0, 0]), (0, 4, [2, 3, 4, 5]), (1, 1, [7])]


def test_next_token_pairs(spark):
    df = spark.createDataFrame([(1, [5, 6, -100])], "k int, labels array<int>")
    got = [(r.pos, r.target) for r in T.next_token_pairs(df, ["k"]).collect()]
    assert got == [(0, 6), (1, -100)]


def test_decode_vocab_skips_special(spark):
    vocab = _vocab(spark, ["he", "llo"])
    df = spark.createDataFrame([(1, [2, 1, 3, 0])], "k int, ids array<int>")
    assert T.decode(df, ["k"], vocab, "ids").first().decoded == "hello"


def test_udf_tokenizer_equals_native_bytes(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    a = U.tokenize_with(df, U.byte_tokenizer_factory(), "text").select("doc_id", "ids")
    b = df.select("doc_id", T.byte_ids("text").alias("ids"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_token_counts_and_unk(spark):
    vocab = _vocab(spark, ["a"])
    df = spark.createDataFrame([("x", "a a b"), ("y", "b")], "g string, text string")
    got = {r.g: (r.n_tokens, r.n_unk, r.n_distinct_ids)
           for r in T.unk_counts(T.token_counts(df, ["g"]), ["g"], vocab).collect()}
    assert got == {"x": (3, 1, 2), "y": (1, 1, 1)}


def test_vocab_threshold_ties_and_small_corpus(spark):
    # counts: z=3, b=2, a=2, c=2, y=1 -> top 2 = z, then the first 2-count token by name
    df = spark.createDataFrame([("z z z b b a a c c y",)], "text string")
    got = sorted((r.id, r.token, r.n) for r in T.build_vocab(df, "text", 2).collect())
    assert got == [(2, "z", 3), (3, "a", 2)]
    # fewer distinct tokens than the size: all of them, ranked
    got = sorted((r.id, r.token) for r in T.build_vocab(df, "text", 100).collect())
    assert got == [(2, "z"), (3, "a"), (4, "b"), (5, "c"), (6, "y")]


def test_lookup_and_join_paths_agree(spark, monkeypatch):
    rows = [(1, "a b a c zz"), (2, None), (3, ""), (4, "c c c b  a"), (5, "unknown words only")]
    df = spark.createDataFrame(rows, "k long, text string")
    vocab = lambda: T.build_vocab(df, "text", 3)
    fast = {r.k: (r.n_raw, r.ids) for r in T.token_ids(df, ["k"], vocab(), "text", max_len=4).collect()}
    back = {r.k: r.decoded for r in T.decode(T.token_ids(df, ["k"], vocab()), ["k"], vocab(), sep=" ", skip_special=False).collect()}
    monkeypatch.setattr(T, "LOCAL_VOCAB_BYTES", -1)
    assert T.local_vocab(vocab()) is None
    slow = {r.k: (r.n_raw, r.ids) for r in T.token_ids(df, ["k"], vocab(), "text", max_len=4).collect()}
    assert fast == slow and fast[2] == (0, []) and len(fast[1][1]) == 4
    assert back == {r.k: r.decoded for r in T.decode(T.token_ids(df, ["k"], vocab()), ["k"], vocab(), sep=" ", skip_special=False).collect()}


def test_count_floor_leaves_the_top(spark):
    import random
    rnd = random.Random(1)
    counts = [int(1 / (rnd.random() + 1e-4)) for _ in range(3000)]
    df = spark.createDataFrame([(f"t{i}", n) for i, n in enumerate(counts)], "token string, n long")
    for size in (1, 10, 100, 2999, 3000, 5000):
        floor = T.count_floor(df, size)
        kept = sum(n >= floor for n in counts)
        assert kept >= min(size, 3000)


def test_python_batches_of_tokens_are_bounded(spark):
    from skein.operators import bpe
    from skein.session import BATCH_BYTES
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    df = spark.createDataFrame([(i, "a b c") for i in range(4)], "id long, text string")
    vocab = T.build_vocab(df, "text", 8, T.PIECE_PATTERN)
    merges = spark.createDataFrame([], "rank int, left string, right string")
    steps = {"ids": lambda: T.token_ids(df, ["id"], vocab), "bpe": lambda: bpe.encode_bpe(df, ["id"], merges, vocab),
             "decode": lambda: T.decode(spark.createDataFrame([(1, [2])], "id long, ids array<int>"), ["id"], vocab)}
    before = spark.conf.get(name)
    try:
        for step, run in steps.items():
            spark.conf.set(name, "64m")
            assert run().count() and spark.conf.get(name) == f"{BATCH_BYTES}b", step
    finally:
        spark.conf.set(name, before)
