"""Losses against numpy, ties, ignored labels."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import scoring as A


def _pred(spark, rows):
    return spark.createDataFrame(rows, "seq_id long, pos int, label int, logits array<double>")


def test_token_scores_match_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(0, p, int(rng.integers(0, 5)), [float(x) for x in rng.normal(size=5) * 3]) for p in range(6)]
    got = A.score_tokens(_pred(spark, rows), "softmax").collect()
    st = A.score_tokens(_pred(spark, rows), "stablemax").collect()
    for r, s, (_, _, y, x) in zip(sorted(got, key=lambda r: r.pos), sorted(st, key=lambda r: r.pos), rows):
        x = np.array(x)
        assert r.nll == pytest.approx(np.log(np.exp(x).sum()) - x[y], rel=1e-9)
        sx = np.where(x < 0, 1 / (1 - x + 1e-30), x + 1)
        assert s.nll == pytest.approx(-np.log(sx[y] / sx.sum()), rel=1e-9)


def test_ties_ignored_and_zero_valid(spark):
    rows = [(0, 0, 1, [2.0, 2.0, 0.0]),     # tie: index 0 wins -> wrong for label 1
            (0, 1, 0, [2.0, 2.0, 0.0]),     # tie: correct for label 0
            (1, 0, -100, [1.0, 0.0, 0.0]),  # all labels ignored
            (1, 1, -100, [0.0, 1.0, 0.0])]
    seq = {r.seq_id: r for r in A.score_sequences(A.score_tokens(_pred(spark, rows))).collect()}
    assert seq[0].n_valid == 2 and seq[0].n_correct == 1 and not seq[0].exact
    assert seq[1].n_valid == 0 and seq[1].exact and seq[1].divisor == 1 and seq[1].nll_sum == 0.0


def test_rollup_and_losses(spark):
    rows = [(0, 0, 0, [3.0, 0.0]), (1, 0, 1, [3.0, 0.0]), (2, 0, -100, [0.0, 0.0])]
    seq = A.score_sequences(A.score_tokens(_pred(spark, rows)))
    halt = spark.createDataFrame([(0, True, 2, 1.0, 0.0, 0.5), (1, True, 3, -1.0, 0.0, None),
                                  (2, False, 8, 0.5, 0.0, 0.2)],
                                 "seq_id long, halted boolean, steps int, q_halt double, q_continue double, "
                                 "target_q_continue double")
    r = A.rollup_scores(seq.join(halt, "seq_id")).first()
    assert r["count"] == 2 and r.exact_accuracy == 1 and r.steps == 5
    assert r.q_halt_accuracy == 2  # seq0: q>=0 and exact; seq1: q<0 and not exact
    bce = lambda x, y: max(x, 0) - x * y + math.log1p(math.exp(-abs(x)))
    assert r.q_halt_loss == pytest.approx(bce(1.0, 1) + bce(-1.0, 0) + bce(0.5, 1))  # all sequences
    assert r.q_continue_loss == pytest.approx(bce(0.0, 0.5) + bce(0.0, 0.2))
    assert r.total_loss == pytest.approx(r.lm_loss + 0.5 * (r.q_halt_loss + r.q_continue_loss))


def test_perplexity_overflow_and_improvement(spark):
    df = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 1.0), ("s", 1, 800.0)], "run_id string, step long, value double")
    assert df.select(A.perplexity(F.col("value")).alias("p")).collect()[2].p == float("inf")
    imp = {r.run_id: r for r in A.improvement(df).collect()}
    assert imp["r"].loss_improvement == pytest.approx(0.5)
    assert imp["r"].ppl_improvement == pytest.approx(1 - math.exp(-1))


def test_improvement_on_a_first_loss_of_zero(spark):
    df = spark.createDataFrame([("up", 1, 0.0), ("up", 2, 1.0), ("down", 1, 0.0), ("down", 2, -1.0), ("flat", 1, 0.0),
                                ("none", 1, None)], "run_id string, step long, value double")
    imp = {r.run_id: r.loss_improvement for r in A.improvement(df).collect()}
    assert imp["up"] == -math.inf and imp["down"] == math.inf and math.isnan(imp["flat"]) and imp["none"] is None


def test_split_sizes_reports_empty_split(spark):
    df = spark.createDataFrame([("train",)] * 3, "split string")
    assert {r.split: r.n_rows for r in A.split_sizes(df).collect()} == {"train": 3, "validation": 0}
