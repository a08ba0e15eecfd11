"""Reservoir shuffle, keyed epoch orders and the draw index against plain loops."""
import hashlib

import pytest
from pyspark.sql import functions as F

from skein.operators import drawindex as D
from skein.operators import mixing as M
from skein.operators import permute as P


def h60(*key):
    return int(hashlib.md5(":".join(map(str, key)).encode()).hexdigest()[:15], 16)


def plain_buffer(n, buffer, seed):
    """What one shuffle buffer gives out, row by row."""
    held, out = [], []
    for t in range(n):
        if len(held) < buffer:
            held.append(t)
            continue
        s = h60(seed, "slot", t) % buffer
        out.append(held[s])
        held[s] = t
    return out + [held[s] for s in sorted(range(len(held)), key=lambda s: (h60(seed, "rest", s), s))]


@pytest.mark.parametrize("n, buffer, parts", [(100, 1, 1), (100, 7, 8), (100, 100, 64), (100, 101, 8), (400, 64, 8),
                                              (300, 3, 64), (1, 5, 1), (0, 4, 2)])
def test_reservoir_equals_one_buffer(spark, n, buffer, parts):
    df = spark.range(n).withColumnRenamed("id", "t").withColumn("slot", F.lit("x")).repartition(parts)
    got = M.shuffle_reservoir(df, "t", buffer, 5)
    assert got.columns == ["t", "slot", "pos"]
    rows = sorted(got.collect(), key=lambda r: r["pos"])
    assert [r["pos"] for r in rows] == list(range(n)) and [r["t"] for r in rows] == plain_buffer(n, buffer, 5)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 63, 1000, 12345])
def test_permutation_is_a_bijection_with_inverse(spark, n):
    for epoch in (0, 3):
        keys = [F.lit(k) for k in P.round_keys(9, epoch)]
        df = spark.range(n).select("id", P.permute(F.col("id"), n, keys).alias("p")) \
            .select("id", "p", P.permute(F.col("p"), n, keys, back=True).alias("b"))
        r = df.agg(F.count_distinct("p").alias("d"), F.min("p").alias("lo"), F.max("p").alias("hi"),
                   F.sum(F.when(F.col("b") != F.col("id"), 1).otherwise(0)).alias("wrong"),
                   F.sum(F.when(F.col("p") == F.col("id"), 1).otherwise(0)).alias("same")).first()
        assert (r["d"], r["lo"], r["hi"], r["wrong"]) == (n, 0, n - 1, 0)
        assert n < 100 or r["same"] < n / 20
        big = 10 ** 10 + 19                                          # beyond 32 bits
        x = spark.range(0, big, big // 50).select("id", P.permute(F.col("id"), big, keys).alias("p"))
        assert all(0 <= a["p"] < big and a["b"] == a["id"] for a in x.select("*", P.permute(F.col("p"), big, keys, True).alias("b")).collect())
        if n > 5:
            break


def test_epochs_share_one_numbering(spark):
    df = spark.range(500).withColumnRenamed("id", "k")
    plans = {e: P.plan_epochs(df, ["k"], batch=8, accum=2, epochs=e, seed=3) for e in (1, 6)}
    shape = {e: p._jdf.queryExecution().optimizedPlan().toString().count("Window") for e, p in plans.items()}
    assert shape[1] == shape[6]
    rows = plans[6].collect()
    orders = []
    for e in range(6):
        own = sorted((r for r in rows if r["epoch"] == e), key=lambda r: r["pos"])
        assert [r["pos"] for r in own] == list(range(500))
        assert all(r["batch"] == e * 63 + r["pos"] // 8 and r["step"] == r["batch"] // 2 for r in own)
        orders.append(tuple(r["k"] for r in own))
    assert len(set(orders)) == 6
    # steps read back without the plan, across an epoch's end
    back = P.rows_of_steps(spark, 500, 8, 2, 20, 70, seed=3).collect()
    want = {(r["epoch"], r["pos"], r["batch"], r["step"], r["k"]) for r in rows if 20 <= r["step"] < 70}
    assert {tuple(r) for r in back} == want
    capped = P.plan_epochs(df, ["k"], batch=8, accum=2, drop_last=True, epochs=50, max_steps=5, seed=3)
    assert capped.count() == 80
    assert P.plan_epochs(spark.range(0).withColumnRenamed("id", "k"), ["k"], 8, epochs=2).count() == 0


def test_numbering_from_a_column_and_null_keys(spark):
    df = spark.createDataFrame([(None,), (3,), (1,), (3,)], "k long")
    assert sorted(r["pos"] for r in P.plan_epochs(df, ["k"], 2, epochs=1).collect()) == [0, 1, 2, 3]
    given = spark.range(9).select((F.col("id") + 100).alias("k"), "id")
    a = {r["k"]: r["pos"] for r in P.plan_epochs(given, ["k"], 2, index="id").collect()}
    assert a == {r["k"]: r["pos"] for r in P.plan_epochs(given.drop("id"), ["k"], 2).collect()}


SIZES, WEIGHTS = {"big": 900, "small": 7, "one": 1}, {"big": 1.0, "small": 2.0, "one": 0.5}


@pytest.mark.parametrize("block", [1, 16, 1 << 16])
@pytest.mark.parametrize("stop", ["all_exhausted", "first_exhausted"])
def test_index_gives_the_plan(spark, block, stop):
    sizes = SIZES if block > 1 else {"big": 40, "small": 7, "one": 1}
    want = {tuple(r) for r in M.draw_plan(spark, sizes, WEIGHTS, 7, stop).select("k", "source", "c", "row", "epoch").collect()}
    index, total = D.draw_index(spark, sizes, WEIGHTS, 7, stop, block)
    assert total == len(want) and {tuple(r) for r in index.plan(0, total).collect()} == want
    lo, hi = total // 3, total - total // 4
    assert {tuple(r) for r in index.plan(lo, hi).collect()} == {r for r in want if lo <= r[0] < hi}
    cursors = index.rank(lo)
    assert cursors == {s: sum(r[1] == s and r[0] < lo for r in want) for s in sizes}
    got = index.select(cursors)                                            # each source's next draw
    for s, k in got.items():
        later = [r[0] for r in want if r[1] == s and r[0] >= lo]
        assert not later or k == min(later)


def test_tiny_weight_on_the_largest_source(spark):
    sizes, weights = {"large": 300, "other": 3}, {"large": 0.01, "other": 0.99}
    index, total = D.draw_index(spark, sizes, weights, 1, block=1024)
    assert total > 20_000 and index.rank(total)["large"] == 300 and index.plan(total - 1, total).first()["source"] == "large"


def test_interleave_from_a_position(spark):
    rows = [(s, i, f"{s}{i}") for s, n in SIZES.items() for i in range(n)]
    data = spark.createDataFrame(rows, "source string, idx long, payload string").repartition(13)
    whole = {(r["k"], r["source"], r["epoch"], r["payload"]) for r in M.interleave(spark, data, WEIGHTS, ["idx"], 3).collect()}
    for start, end in [(0, None), (500, None), (700, 1200), (10 ** 9, None)]:
        got = {(r["k"], r["source"], r["epoch"], r["payload"])
               for r in D.interleave_indexed(spark, data, WEIGHTS, ["idx"], 3, start=start, end=end, block=64).collect()}
        assert got == {r for r in whole if start <= r[0] < (end or 10 ** 12)}
    with pytest.raises(ValueError):
        D.draw_index(spark, {"a": 0}, {"a": 1.0})
    with pytest.raises(ValueError):
        D.draw_index(spark, {"a": 1}, {"a": 0.0})
