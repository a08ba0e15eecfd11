"""X4 on the state store: exact quotas over many triggers, a restart, a hot source, null sources."""
import pandas as pd
from pyspark.sql import functions as F

from skein.streaming import quota as Q

SCHEMA = "idx long, source string, note string"


def _file(spark, path, lo, hi):
    i = F.col("id")
    spark.range(lo, hi).select(i.alias("idx"), F.when(i % 3 > 0, "hot").when(i % 6 == 0, "b").alias("source"), F.lit("x").alias("note")) \
        .orderBy(F.desc("idx")).coalesce(1).write.mode("append").parquet(path)


def _run(spark, path, q):
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    Q.stream_quota_state(sdf, "source", ["idx"], q).writeStream.format("parquet").option("path", f"{path}/out") \
        .option("checkpointLocation", f"{path}/ck").trigger(availableNow=True).start().awaitTermination()
    return sorted(((r["source"], r["idx"]) for r in spark.read.schema(SCHEMA).parquet(f"{path}/out").collect()), key=repr)


def _want(n, q):
    out = {}
    for i in range(n):
        s = "hot" if i % 3 else "b" if i % 6 == 0 else None
        if out.setdefault(s, []) is not None and len(out[s]) < q:
            out[s].append(i)
    return sorted(((s, i) for s, v in out.items() for i in v), key=repr)


def test_quota_over_triggers_and_a_restart(spark, tmpdir_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    try:
        for lo in (0, 100, 200):
            _file(spark, f"{tmpdir_path}/in", lo, lo + 100)
        assert _run(spark, tmpdir_path, 60) == _want(300, 60)          # b has not reached its quota yet
        _file(spark, f"{tmpdir_path}/in", 300, 900)
        assert _run(spark, tmpdir_path, 60) == _want(900, 60)          # a new query goes on from the checkpoint
        assert _run(spark, tmpdir_path, 60) == _want(900, 60)          # nothing new, nothing taken again
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_least_rows_holds_few(monkeypatch):
    frames = [pd.DataFrame({"k": [9 - i % 10, None, i], "v": [i] * 3}) for i in range(50)]
    most = []
    concat = pd.concat
    monkeypatch.setattr(pd, "concat", lambda p, *a, **b: most.append(sum(map(len, p))) or concat(p, *a, **b))
    got = Q.least_rows(iter(frames), ["k"], 55)
    want = concat(frames).sort_values("k", kind="stable", na_position="first").head(55)
    assert got["k"].fillna(-1).tolist() == want["k"].fillna(-1).tolist() and max(most) <= 2 * 55 + 3
    assert Q.least_rows(iter(frames), ["k"], 0) is None and Q.least_rows(iter([]), ["k"], 3) is None
