"""Shard sets: round trip, reads by position, versions, aborted writes, damage."""
import glob
import os

import pytest
from pyspark.sql import functions as F

from skein.sources import shards as S

SCHEMA = "k long, s string, a array<int>, m map<string,int>"


def _table(spark, n, parts):
    k = F.col("id")
    return spark.range(0, n, 1, parts).select(
        (n - 1 - k).alias("k"), F.when(k % 3 > 0, F.concat(F.lit("t"), k)).alias("s"),
        F.when(k % 5 > 0, F.array(k.cast("int"), F.lit(None).cast("int"))).alias("a"),
        F.when(k % 2 > 0, F.create_map(F.lit("x"), k.cast("int"))).alias("m"))


def _rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=lambda r: int(r[0]))


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_round_trip_and_reads_by_position(spark, tmpdir_path, parts):
    df = _table(spark, 500, parts)
    m = S.write_shard_set(df, tmpdir_path, 3, 8).orderBy("first").collect()
    assert sum(r["n_rows"] for r in m) == 500 and len(m) <= 8 and all(r["n_bytes"] > 0 for r in m)
    assert all(a["last"] < b["first"] for a, b in zip(m, m[1:], strict=False))
    assert _rows(S.read_shard_set(spark, tmpdir_path)) == _rows(df)
    for start, stop in ((0, None), (137, None), (499, None), (500, None), (None, 20), (200, 260), (260, 200)):
        got = S.read_shard_set(spark, tmpdir_path, start, stop)
        lo, hi = start or 0, 500 if stop is None else stop
        assert [int(r[0]) for r in _rows(got)] == list(range(lo, hi))
        meets = [r["file"] for r in m if r["last"] >= lo and r["first"] < hi]
        assert len(got.inputFiles()) == (len(meets) if lo < 500 else 0)            # no other shard is opened
    assert S.damaged_shards(spark, tmpdir_path).count() == 0


def test_versions_and_writes_again(spark, tmpdir_path):
    S.write_shard_set(_table(spark, 50, 2), tmpdir_path, 1, 4)
    S.write_shard_set(_table(spark, 30, 2), tmpdir_path, 2, 4)
    assert S.read_shard_set(spark, tmpdir_path).count() == 30
    assert S.read_shard_set(spark, tmpdir_path, version=1).count() == 50
    S.write_shard_set(_table(spark, 40, 2), tmpdir_path, 1, 4)                     # a job that runs again
    assert S.read_shard_set(spark, tmpdir_path, version=1).count() == 40
    assert S.read_shard_set(spark, tmpdir_path).count() == 30
    with pytest.raises(ValueError, match="no such version"):
        S.read_shard_set(spark, tmpdir_path, version=9)


def test_aborted_write_shows_nothing(spark, tmpdir_path):
    S.write_shard_set(_table(spark, 50, 2), tmpdir_path, 1, 4)
    broken = _table(spark, 60, 4).withColumn("k", F.when(F.col("k") == 17, F.lit(None)).otherwise(F.col("k")))
    with pytest.raises(Exception, match="null position"):
        S.write_shard_set(broken, tmpdir_path, 2, 4)
    whole = _table(spark, 60, 4)
    whole.write.parquet(f"{tmpdir_path}/data/2-abc")                               # data without a manifest
    assert S.read_shard_set(spark, tmpdir_path).count() == 50
    assert S.damaged_shards(spark, tmpdir_path).count() == 0


def test_damage_is_seen(spark, tmpdir_path):
    m = S.write_shard_set(_table(spark, 80, 2), tmpdir_path, 1, 4).orderBy("first").collect()
    file = f"{tmpdir_path}/{m[1]['file']}"
    spark.read.parquet(file).withColumn("s", F.lit("other")).coalesce(1).write.parquet(f"{tmpdir_path}/other")
    data = open(glob.glob(f"{tmpdir_path}/other/*.parquet")[0], "rb").read()
    open(file, "wb").write(data)
    crc = os.path.join(os.path.dirname(file), "." + os.path.basename(file) + ".crc")
    if os.path.exists(crc):
        os.remove(crc)
    got = S.damaged_shards(spark, tmpdir_path).collect()
    assert [(r["file"], r["n_rows"], r["found_rows"]) for r in got] == [(m[1]["file"], m[1]["n_rows"], m[1]["n_rows"])]


def test_empty_table_and_equal_positions(spark, tmpdir_path):
    S.write_shard_set(spark.createDataFrame([], SCHEMA), tmpdir_path, 1, 4)
    got = S.read_shard_set(spark, tmpdir_path)
    assert got.count() == 0 and got.schema.simpleString() == spark.createDataFrame([], SCHEMA).schema.simpleString()
    assert S.damaged_shards(spark, tmpdir_path).count() == 0
    hot = spark.range(0, 900, 1, 8).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id")).alias("k"), "id")
    S.write_shard_set(hot, tmpdir_path, 2, 8)
    assert S.read_shard_set(spark, tmpdir_path).count() == 900
    assert S.read_shard_set(spark, tmpdir_path, 7, 8).count() == 301
