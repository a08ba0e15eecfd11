"""Global index and scans equal single-task windows, for any partitioning."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from skein.operators.ordering import global_index, prefix_sum, scan


def _df(spark, rows, parts):
    return spark.createDataFrame(rows, "g string, k long, v long").repartition(parts)


def test_global_index_equals_row_number(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("abc"), k, rnd.randint(-5, 9)) for k in rnd.sample(range(10**9), 500)]
    want = sorted((r[1], i) for i, r in enumerate(sorted(rows, key=lambda r: r[1])))
    for parts in (1, 8, 64):
        got = global_index(_df(spark, rows, parts), ["k"], name="i").select("k", "i").collect()
        assert sorted((r.k, r.i) for r in got) == want


def test_partitioned_index_and_scans_match_windows(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice(["hot"] * 8 + ["x", "y"]), k, rnd.randint(-20, 20)) for k in range(400)]
    df = _df(spark, rows, 5)
    w = Window.partitionBy("g").orderBy("k")
    ref = df.select("g", "k", (F.row_number().over(w) - 1).alias("i"),
                    F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("s"),
                    F.max("v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("mx"),
                    F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("mn"))
    got = global_index(df, ["k"], "g", name="i")
    got = prefix_sum(got, "v", ["k"], "g", name="s")
    got = scan(got, "v", ["k"], "g", name="mx", how="max", inclusive=False)
    got = scan(got, "v", ["k"], "g", name="mn", how="min", inclusive=True)
    a = sorted(tuple(r) for r in ref.collect())
    b = sorted(tuple(r) for r in got.select("g", "k", "i", "s", "mx", "mn").collect())
    assert a == b


def test_no_unpartitioned_window_over_data(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    plan = global_index(df, ["k"])._jdf.queryExecution().executedPlan().toString()
    # The only window without partition keys runs on the bucket table.
    assert "SinglePartition" not in plan or "_skein_bucket" in plan


@settings(max_examples=15, deadline=None)
@given(st.lists(st.integers(min_value=-1000, max_value=1000), min_size=1, max_size=60, unique=True))
def test_index_property(spark, keys):
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: r.idx for r in global_index(df, ["k"], buckets=4).collect()}
    assert got == {k: i for i, k in enumerate(sorted(keys))}
