"""Losses over vocabulary shards, split vector lookups and repeatable metric writes."""
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from skein.operators import scoring as A
from skein.operators import sharded as S
from skein.operators import vectors as J
from skein.sources import sinks


def _pred(spark, n=120, classes=37):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        x = [rnd.choice([-3.0, 0.0, 2.5, rnd.uniform(-50, 50)]) for _ in range(classes)]
        if i % 10 == 0:
            x[: classes // 2] = [float("-inf")] * (classes // 2)
        rows.append((i // 8, i % 8, -100 if i % 5 == 0 else classes - 1 - rnd.randrange(classes // 2), x))
    return spark.createDataFrame(rows, "seq_id long, pos int, label int, logits array<double>")


@pytest.mark.parametrize("kind", ["softmax", "stablemax"])
@pytest.mark.parametrize("width, parts", [(1, 8), (10, 1), (10, 64), (37, 8), (100, 8)])
def test_shards_give_the_loss_of_whole_logits(spark, kind, width, parts):
    pred = _pred(spark)
    want = {(r["seq_id"], r["pos"]): r for r in A.score_tokens(pred, kind).collect()}
    got = S.score_shards(S.shard_logits(pred, width).repartition(parts), ["seq_id", "pos"], width, kind).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r["seq_id"], r["pos"]]
        assert (r["valid"], r["correct"]) == (w["valid"], w["correct"])
        assert math.isclose(r["nll"], w["nll"], rel_tol=1e-9, abs_tol=1e-9)


def test_shards_edges(spark):
    rows = [(1, 2, 0, [1.0, 2.0]), (1, 2, 1, [3.0]), (1, 2, 2, None), (2, 9, 0, [1.0, 1.0]), (3, -100, 0, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "k int, label int, shard int, block array<double>")
    got = {r["k"]: r for r in S.score_shards(df, ["k"], 2).collect()}
    assert got[1]["correct"] and math.isclose(got[1]["nll"], math.log(sum(map(math.exp, (1, 2, 3)))) - 3)
    assert got[2]["nll"] is None and got[3]["nll"] == 0.0 and not got[3]["valid"]
    assert S.score_shards(df.limit(0), ["k"], 2).collect() == []
    with pytest.raises(ValueError):
        S.score_shards(df, ["k"], 2, "other")


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_frequent_values_are_found(spark, parts):
    rnd = random.Random(5)
    ids = [7] * 4000 + [9] * 900 + [rnd.randrange(100, 9000) for _ in range(7000)] + [None] * 50
    rnd.shuffle(ids)
    df = spark.createDataFrame([(i,) for i in ids], "v int").repartition(parts)
    got = {r["value"]: r["least"] for r in J.frequent(df, "v", 20).collect()}
    real = Counter(ids)
    assert {v for v, n in real.items() if v is not None and n > len(ids) / 20} <= set(got)
    assert all(n <= real[v] for v, n in got.items())
    assert J.frequent(df.limit(0), "v", 20).count() == 0


@pytest.mark.parametrize("counters", [1, 4, 1024])
def test_split_lookup_equals_plain_lookup(spark, counters):
    rnd = random.Random(3)
    rows = [(i, [5 if rnd.random() < .4 else rnd.randrange(60) for _ in range(rnd.randrange(20))] + [None]) for i in range(80)]
    df = spark.createDataFrame(rows, "k int, ids array<int>").repartition(8)
    vec = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50) if i % 7], "id long, vec array<double>")
    key = lambda d: sorted((r["k"], r["pos"], r["id"], tuple(r["vec"])) for r in d.collect())
    assert key(J.lookup_vectors_split(df, ["k"], "ids", vec, counters=counters)) == key(J.lookup_vectors(df, ["k"], "ids", vec))
    assert J.lookup_vectors_split(df.limit(0), ["k"], "ids", vec).count() == 0


def test_metrics_written_again_count_once(spark, tmpdir_path):
    path = f"{tmpdir_path}/m"
    rows = spark.createDataFrame([("a", 1, "loss", 2.0), ("a", 1, "loss", 2.5), ("a", 2, "loss", 1.0), ("b", 1, "acc", .5)],
                                 "run_id string, step int, metric string, value double")
    for _ in range(2):
        sinks.put_metrics(rows, path, "w1")
    sinks.put_metrics(rows.filter("metric = 'acc'"), path, "w2")
    got = sorted((r["run_id"], r["step"], r["metric"], r["value"], r["write_id"]) for r in spark.read.parquet(path).collect())
    assert got == [("a", 1, "loss", 2.5, "w1"), ("a", 2, "loss", 1.0, "w1"), ("b", 1, "acc", .5, "w1"), ("b", 1, "acc", .5, "w2")]
    assert spark.read.parquet(path).filter(F.col("metric") == "loss").count() == 2
