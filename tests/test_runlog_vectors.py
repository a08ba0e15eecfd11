"""R1-R4, F4, F5 and J1-J6 edge cases."""
import math

import pytest

from skein.operators import runlog as R
from skein.operators import vectors as J


def _m(spark, rows):
    return spark.createDataFrame(rows, "run_id string, step long, value double")


def test_nonfinite_and_best_ties(spark):
    m = _m(spark, [("a", 1, float("nan")), ("a", 2, 3.0), ("a", 3, float("inf")), ("a", 4, 3.0), ("a", 5, 4.0)])
    assert R.drop_nonfinite(m).count() == 3
    rep = R.nonfinite_report(m).first()
    assert (rep.n_kept, rep.n_dropped) == (3, 2)
    best = R.best_checkpoint(R.drop_nonfinite(m)).first()
    assert (best.best_step, best.best_value) == (2, 3.0)      # equal best values -> earliest
    assert R.latest_checkpoint(m).first().latest_step == 5


def test_early_stop_no_improvement(spark):
    m = _m(spark, [("a", i, 5.0) for i in range(1, 8)] + [("b", i, 10.0 - i) for i in range(1, 8)])
    got = {r.run_id: r for r in R.early_stop(m, patience=3).collect()}
    assert got["a"].stop_step == 4 and got["a"].stop_eval == 4  # evals 2,3,4 do not improve on eval 1
    assert got["b"].stop_step is None


def test_retention_and_cadence(spark):
    m = _m(spark, [("a", s, v) for s, v in [(1, 1.0), (10, 2.0), (20, 3.0), (30, 4.0), (35, 5.0)]])
    kept = {(r.step, r.is_recent, r.is_best) for r in R.retain(m, 2, R.best_checkpoint(m)).collect()}
    assert kept == {(1, False, True), (30, True, False), (35, True, False)}
    assert sorted(r.step for r in R.cadence(m, 10).collect()) == [1, 10, 20, 30]


def test_sign_update_touched_only(spark):
    w = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "id int, w array<double>")
    g = spark.createDataFrame([(1, [-0.5, None], 1), (3, [2.0, 2.0], 1)], "id int, grad array<double>, n long")
    got = {r.id: r for r in J.sign_update(w, g).collect()}
    assert got[1].w == pytest.approx([1.0 * (1 - 1e-5) + 1e-3, 2.0]) and got[1].updated
    assert got[2].w == [1.0, 2.0] and not got[2].updated
    assert 3 not in got                                       # gradient without a weight row is ignored
    short = J.sign_update(w, spark.createDataFrame([(2, [1.0], 1)], g.schema)).filter("id = 2").first()
    assert short.w == pytest.approx([1.0 * (1 - 1e-5) - 1e-3, 2.0])


def test_sum_and_mean_of_vectors_and_rms(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (1, [3.0, 4.0]), (2, [1.0, 1.0]), (3, [5.0])], "id int, grad array<double>")
    got = {r.id: (r.grad, r.n) for r in J.sum_vectors(df).collect()}
    assert got == {1: ([4.0, 6.0], 2), 2: ([1.0, 1.0], 1), 3: ([5.0, None], 1)}
    mean = {r.id: r.vec for r in J.mean_pool(df.withColumnRenamed("grad", "vec"), ["id"]).collect()}
    assert mean[1] == [2.0, 3.0]
    assert J.sum_vectors(df.limit(0)).count() == 0
    y = spark.createDataFrame([([3.0, 4.0],)], "v array<double>").select(J.rms_norm("v").alias("y")).first().y
    assert y == pytest.approx([3 / math.sqrt(12.5 + 1e-5), 4 / math.sqrt(12.5 + 1e-5)])


def test_resize_vectors(spark):
    vec = spark.createDataFrame([(i, [float(i)] * 4) for i in range(5)], "id long, vec array<double>")
    grow = {r.id: r for r in J.resize_vectors(vec, 5, 300, 4, seed=1).collect()}
    assert [grow[i].vec for i in range(5)] == [[float(i)] * 4 for i in range(5)]
    new = [x for i in range(5, 300) for x in grow[i].vec]
    mean = sum(new) / len(new)
    sd = math.sqrt(sum((x - mean) ** 2 for x in new) / len(new))
    assert abs(mean) < 0.005 and 0.017 < sd < 0.023
    shrink = J.resize_vectors(vec, 5, 3, 4).collect()
    assert sorted(r.id for r in shrink) == [0, 1, 2]


def test_refresh(spark):
    old = spark.createDataFrame([(0, "o0"), (1, "o1")], "slot long, x string")
    new = spark.createDataFrame([(0, "n0"), (1, "n1")], "slot long, x string")
    flag = spark.createDataFrame([(0, True), (1, False)], "slot long, halted boolean")
    assert {r.slot: r.x for r in J.refresh(old, new, flag).collect()} == {0: "n0", 1: "o1"}
