"""Sketches against exact counts: bounds, merging of increments, edge rows."""
import random

import pytest

from skein.operators import sketches as K


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_estimates_unions_and_intersections_keep_their_bounds(spark, parts):
    rnd = random.Random(4)
    rows = [(rnd.choice(["hot", "hot", "b", None]), rnd.choice(["train", "eval"]), f"w{int(rnd.paretovariate(.25)) % 60_000}") for _ in range(60_000)]
    rows += [("hot", "train", None)] * 10
    df = spark.createDataFrame(rows, "source string, part string, word string").repartition(parts)
    table = K.sketch_table(df, ["source", "part"], "word")
    real = {}
    for s, p, w in rows:
        if w is not None:
            real.setdefault((s, p), set()).add(w)
    for r in K.estimates(table).collect():
        n = len(real[r["source"], r["part"]])
        assert abs(r["estimate"] - n) <= r["margin"] and r["margin"] <= 0.07 * n + 1
    for r in K.estimates(K.merge_sketches(table, ["source"])).collect():
        n = len(real[r["source"], "train"] | real[r["source"], "eval"])
        assert abs(r["estimate"] - n) <= r["margin"]
    got = K.overlaps(table.filter("part = 'train'"), table.filter("part = 'eval'"), ["source"]).collect()
    assert {r["source"] for r in got} == {"hot", "b", None}
    for r in got:
        assert abs(r["estimate"] - len(real[r["source"], "train"] & real[r["source"], "eval"])) <= r["margin"]


def test_increments_merge_and_small_counts_are_exact(spark):
    days = [spark.createDataFrame([("a", f"w{i}") for i in range(d * 300, d * 300 + 600)], "source string, word string") for d in range(5)]
    table = K.sketch_table(days[0], ["source"], "word")
    for d in days[1:]:
        table = K.merge_sketches(table.unionByName(K.sketch_table(d, ["source"], "word")), ["source"])
    r = K.estimates(table).first()
    assert (r["estimate"], r["n_rows"]) == (1800, 3000)                  # below 2^12 values: exact
    assert K.sketch_table(days[0].limit(0), ["source"], "word").count() == 0
    none = spark.createDataFrame([("a", None)], "source string, word string")
    assert K.estimates(K.sketch_table(none, ["source"], "word")).first()["estimate"] == 0
