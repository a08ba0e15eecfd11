"""M1-M5: weights, interleave coverage and shares, shuffles, batch plans."""
import math

import pytest
from pyspark.sql import functions as F

from skein.operators import batches as N
from skein.operators import mixing as M
from skein.sources.mix import build_mix, normalise_mix


def _data(spark, sizes):
    rows = [(s, i, f"{s}{i}") for s, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "source string, idx long, payload string")


def test_mix_validation(spark):
    with pytest.raises(ValueError, match="unknown source keys"):
        build_mix(spark, [{"name": "a", "wandb_project": "x"}])
    with pytest.raises(ValueError, match="positive"):
        build_mix(spark, [{"name": "a", "weight": 0}])
    m = normalise_mix(build_mix(spark, [{"name": "a", "weight": "3"}, {"name": "b", "weight": "1e0"}]))
    assert {r.source: r.weight_norm for r in m.collect()} == {"a": 0.75, "b": 0.25}


def test_interleave_all_exhausted_covers_every_row(spark):
    sizes = {"big": 300, "small": 7, "one": 1}
    w = {"big": 1.0, "small": 2.0, "one": 1.0}
    out = M.interleave(spark, _data(spark, sizes), w, ["idx"], seed=1)
    rows = out.collect()
    ks = sorted(r.k for r in rows)
    assert ks == list(range(len(ks)))                       # positions are 0..K-1
    for s, n in sizes.items():
        assert {r.idx for r in rows if r.source == s} == set(range(n))
    # the last position completes the last source's first pass
    firsts = {}
    for r in sorted(rows, key=lambda r: r.k):
        if r.epoch == 0:
            firsts[r.source] = r.k
    assert max(firsts.values()) == len(ks) - 1
    # shares within 4 sigma of the weights
    K = len(ks)
    for s, wt in w.items():
        p = wt / sum(w.values())
        cnt = sum(1 for r in rows if r.source == s)
        assert abs(cnt - K * p) <= 4 * math.sqrt(K * p * (1 - p)) + 1


def test_interleave_zero_weight_and_single_source(spark):
    out = M.interleave(spark, _data(spark, {"a": 5, "z": 3}), {"a": 1.0, "z": 0.0}, ["idx"])
    rows = out.collect()
    assert {r.source for r in rows} == {"a"} and sorted(r.idx for r in rows) == list(range(5))


def test_first_exhausted_stops_before_a_repeat(spark):
    rows = M.interleave(spark, _data(spark, {"a": 4, "b": 50}), {"a": 1.0, "b": 1.0}, ["idx"],
                        stop="first_exhausted").collect()
    assert all(r.epoch == 0 for r in rows)
    assert sum(1 for r in rows if r.source == "a") == 4
    last = max(rows, key=lambda r: r.k)
    assert (last.source, last.idx) == ("a", 3)                      # ends with the first source's last row


def test_shuffles_are_permutations(spark):
    df = spark.range(200).withColumnRenamed("id", "k")
    g = [r.pos for r in M.shuffle_global(df, ["k"], 5).collect()]
    assert sorted(g) == list(range(200))
    b = M.shuffle_buffered(df, "k", 50, 5).collect()
    assert sorted(r.pos for r in b) == list(range(200))
    assert all(r.pos // 50 == r.k // 50 for r in b)


def test_batch_plan_drop_last_and_resume(spark):
    df = spark.range(10).withColumnRenamed("id", "k")
    plan = N.plan_batches(df, ["k"], batch=4, accum=2, drop_last=True, epochs=2).collect()
    assert len(plan) == 16 and max(r.batch for r in plan) == 3 and max(r.step for r in plan) == 1
    for e in (0, 1):
        assert len({r.k for r in plan if r.epoch == e}) == 8
    capped = N.resume(N.plan_batches(df, ["k"], batch=4, accum=1, epochs=2, max_steps=5), 2).collect()
    assert sorted({r.step for r in capped}) == [2, 3, 4]


def test_shuffle_is_independent_of_interleave_draws(spark):
    # The source draw and the shuffle key must come from different hash
    # streams; otherwise a shuffled plan comes out sorted by source.
    data = _data(spark, {"a": 200, "b": 200, "c": 200})
    plan = M.interleave(spark, data, {"a": 1.0, "b": 1.0, "c": 1.0}, ["idx"])
    sh = M.shuffle_global(plan.select("k", "source"), ["k"], name="pos")
    head = {r.source for r in sh.filter("pos < 30").collect()}
    assert head == {"a", "b", "c"}
