"""L1-L9 edge cases."""
import pytest
from pyspark.sql import functions as F

from skein.operators import ordering as O
from skein.operators import sampling as L


def _gappy(spark, n):
    """Groups and leading keys with NULLs."""
    return spark.range(n).select(F.when(F.col("id") % 5 != 0, F.col("id") % 2).alias("g"),
                                 F.when(F.col("id") % 3 != 0, -F.col("id")).alias("k"), "id")


def _expect(rows, q):
    out = set()
    for g in {r.g for r in rows}:
        mine = sorted((r for r in rows if r.g == g), key=lambda r: (r.k is not None, r.k or 0, r.id))
        out |= {(r.id, i + 1) for i, r in enumerate(mine[:q])}
    return out


@pytest.mark.parametrize("q", [999, 1000, 1001])
def test_quota_plans_agree_around_the_threshold(spark, q):
    df = _gappy(spark, 4000)
    want = _expect(df.collect(), q)
    for how in ("auto", "topk", "index"):
        assert {(r.id, r["rank"]) for r in L.eval_quota(df, "g", ["k", "id"], q, "rank", how).collect()} == want
    assert L.eval_quota(df, "g", ["k", "id"], q).columns == df.columns
    a, b = (sorted(r.id for r in L.eval_sample(df, "g", ["id"], q, how=how).collect()) for how in ("topk", "index"))
    assert a == b and len(a) == 3 * min(q, 800) + 2 * (min(q, 1600) - min(q, 800))


def test_index_and_scan_keep_null_groups_and_keys(spark):
    df = _gappy(spark, 300)
    rows = df.collect()
    got = O.global_index(df, ["k", "id"], "g", name="pos", buckets=7).collect()
    assert {(r.id, r.pos + 1) for r in got} == _expect(rows, 300)
    cum = {r.id: r.cum for r in O.scan(df, F.lit(1), ["k", "id"], "g", buckets=7).collect()}
    assert cum == {r.id: r.pos + 1 for r in got}


def test_head_n_is_one_definition(spark):
    df = _gappy(spark, 50).select("k", "id")
    a, b = (sorted(r.id for r in L.head_n(df, ["k", "id"], 20, how).collect()) for how in ("topk", "index"))
    assert a == b and len(a) == 20 and {0, 3, 6} <= set(a)           # NULL keys first


def test_eval_set_cap_without_ranks(spark):
    df = spark.createDataFrame([("b", i) for i in range(30)] + [("a", i) for i in range(30)], "source string, idx long")
    order = spark.createDataFrame([("a", 1), ("b", 0)], "source string, src_pos int")
    got = sorted((r.source, r.idx) for r in L.eval_set(df, order, ["idx"], 40).collect())
    assert got == [("a", i) for i in range(10)] + [("b", i) for i in range(30)]


def test_subsample_reference_mode_shuffles(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    got = sorted((r.pos, r.k) for r in L.subsample(df, 0.3, ["k"], mode="reference").collect())
    assert [p for p, _ in got] == list(range(100)) and [k for _, k in got] != list(range(100))
    assert sorted(k for _, k in got) == list(range(100))


def test_head_n_edges(spark):
    df = spark.range(30).withColumnRenamed("id", "k")
    assert L.head_n(df, ["k"], 0).count() == 0
    assert L.head_n(df, ["k"], 100).count() == 30
    assert L.head_n(df, ["k"], None).count() == 30
    assert sorted(r.k for r in L.head_n(df, ["k"], 7, how="index").collect()) == list(range(7))


def test_tail_split_disjoint_complete(spark):
    for n in (1, 9, 10, 11, 57):
        df = spark.range(n).withColumnRenamed("id", "k")
        rows = L.tail_split(df, ["k"]).collect()
        tr = {r.k for r in rows if r.split == "train"}
        ev = {r.k for r in rows if r.split == "validation"}
        assert not tr & ev and tr | ev == set(range(n)) and len(tr) == int(n * 0.9)


def test_quota_zero_and_sample_all(spark):
    df = spark.createDataFrame([("a", i) for i in range(3)] + [("b", 0)], "source string, idx long")
    assert L.eval_quota(df, "source", ["idx"], 0).count() == 0          # size < n_sources
    assert L.eval_sample(df, "source", ["idx"], 10).count() == 4        # all rows when len <= q
    assert L.eval_sample(df, "source", ["idx"], 2).filter("source = 'a'").count() == 2


def test_overlap_and_exclude(spark):
    tr = spark.createDataFrame([(i,) for i in range(10)], "idx long")
    ev = spark.createDataFrame([(i,) for i in (3, 4, 42)], "idx long")
    assert sorted(r.idx for r in L.overlap(tr, ev, ["idx"]).collect()) == [3, 4]
    assert L.exclude_eval(tr, ev, ["idx"]).count() == 8
