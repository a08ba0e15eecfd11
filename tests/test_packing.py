"""K1/K2: block rules and token conservation."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein.operators.packing import pack_ids, pack_lists
from skein.operators.tokens import byte_ids


def _pack(spark, lists, B, rows_per_group):
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lists)], "k long, ids array<int>")
    out = pack_ids(df, "ids", ["k"], B, rows_per_group).collect()
    return sorted((r.pack_group, r.block, r.input_ids) for r in out)


def _reference(lists, B, rows_per_group):
    groups = [lists] if rows_per_group is None else [lists[i:i + rows_per_group]
                                                     for i in range(0, len(lists), rows_per_group)]
    out = []
    for g, rows in enumerate(groups):
        flat = [x for r in rows for x in r]
        total = len(flat)
        if total >= B:
            total = (total // B) * B
        out += [(g, i // B, flat[i:i + B]) for i in range(0, total, B)]
    return sorted(out)


def test_pack_cases(spark):
    B = 4
    assert _pack(spark, [[], []], B, 10) == []                                   # total 0
    assert _pack(spark, [[2], [3, 4]], B, 10) == [(0, 0, [2, 3, 4])]             # < B: one short block
    assert _pack(spark, [[2, 3], [4, 5]], B, 10) == [(0, 0, [2, 3, 4, 5])]       # = B
    assert _pack(spark, [[1] * 5, [2] * 4], B, 10) == [(0, 0, [1] * 4), (0, 1, [1, 2, 2, 2])]  # 2B+1


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.integers(2, 50), max_size=9), min_size=1, max_size=12),
       st.integers(1, 6), st.one_of(st.none(), st.integers(1, 5)))
def test_pack_matches_reference(spark, lists, B, g):
    assert _pack(spark, lists, B, g) == _reference(lists, B, g)


def test_lists_made_from_texts_are_not_shuffled(spark):
    texts = ["abc", None, "", "défg" * 5, "x" * 11] * 9
    df = spark.createDataFrame(list(enumerate(texts)), "k long, text string").repartition(4)
    ids = byte_ids("text")
    lists = {"ids": ids, "place": F.transform(ids, lambda x, i: i)}
    for g in (4, 100, None):
        out = pack_lists(df, lists, ["k"], 8, g)
        plain = pack_lists(df.select("k", *[c.alias(n) for n, c in lists.items()]), ["ids", "place"], ["k"], 8, g)
        assert out.columns == plain.columns and sorted(out.collect()) == sorted(plain.collect())
        assert sorted((r.pack_group, r.block, r.ids) for r in out.collect()) == _reference(
            [[b + 2 for b in (t or "").encode()] for t in texts], 8, g)


def test_pack_columns_shuffles_texts(spark, tmp_path):
    from skein.plans.registry import all_queries
    spark.createDataFrame([(i, "some text") for i in range(300)], "doc_id long, text string") \
        .write.parquet(f"{tmp_path}/documents.parquet")
    plan = all_queries()["pack_columns"](spark, str(tmp_path))._jdf.queryExecution().executedPlan()
    below = plan.toString().split("Window", 1)[1]          # the lists are made above the last window
    assert "ids#" not in below and "place#" not in below
