"""S1-S11 readers/sinks and X1-X4 stream = batch."""
import os

import pytest
from pyspark.sql import functions as F

from skein.operators import tokens as T
from skein.sources import readers as S
from skein.sources import sinks
from skein.sources.mix import build_mix, eval_split
from skein.streaming import prepare as X


def test_read_source_formats_splits_globs(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "corpus")
    df = spark.createDataFrame([(i, f"t{i}", "train" if i < 6 else "validation") for i in range(8)],
                               "id long, text string, split string")
    df.write.partitionBy("split").parquet(os.path.join(base, "cfgA"))
    tr = S.read_source(spark, {"name": "c", "path": base, "config": "cfgA"})
    assert tr.count() == 6 and set(tr.columns) >= {"source", "split"}
    assert S.read_source(spark, {"name": "c", "path": base, "config": "cfgA"}, split="validation").count() == 2
    js = os.path.join(tmpdir_path, "js")
    df.drop("split").write.json(js)
    j = S.read_source(spark, {"name": "j", "path": js, "format": "json", "data_files": ["part-*"]})
    assert j.count() == 8 and j.first().split == "train"
    with pytest.raises(ValueError):
        S.read_source(spark, {"name": "j", "path": js, "format": "json"}, split="validation")
    txt = os.path.join(tmpdir_path, "txt")
    df.select("text").write.text(txt)
    assert S.read_source(spark, {"name": "t", "path": txt, "format": "text"}).count() == 8


def test_eval_split_rule(spark):
    m = build_mix(spark, [{"name": "a", "split": "test", "available_splits": ["train", "validation"]},
                          {"name": "b"}])
    assert {r.source: r.eval_split for r in eval_split(m).collect()} == {"a": "validation", "b": "train"}


def test_sinks(spark, tmpdir_path):
    df = spark.range(100).withColumnRenamed("id", "k")
    out = os.path.join(tmpdir_path, "shards")
    sinks.write_shards(df, out, 4)
    back = spark.read.parquet(out)
    assert back.count() == 100
    m = spark.createDataFrame([("r", 1, "loss", 2.0)], "run_id string, step long, metric string, value double")
    p = os.path.join(tmpdir_path, "metrics")
    sinks.append_metrics(m, p)
    sinks.append_metrics(m, p)
    assert spark.read.parquet(p).count() == 2


def test_stream_prepare_equals_batch(spark, tmpdir_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "text")
    vocab = T.build_vocab(docs, "text", 256)
    vp = os.path.join(tmpdir_path, "vocab")
    vocab.write.parquet(vp)
    vocab = spark.read.parquet(vp)

    def prep(b):
        return T.tokenize(b.select("doc_id", "lang", "text"), ["doc_id"], vocab, "text", 64)

    sdf = X.file_stream(spark, sf, docs.schema, glob="documents.parquet")
    sink, ck = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck")
    X.stream_prepare(sdf, prep, sink, ck).awaitTermination()
    a = X.read_batches(spark, sink).drop("batch_id")
    b = prep(docs)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("name", ["stream_bytes", "stream_prepare", "stream_quota", "stream_shuffle", "stream_take"])
def test_streams_of_a_table_in_one_file_and_in_a_folder(spark, tmpdir_path, name):
    from skein.plans.registry import all_queries
    rows = [(i, ("en", "de")[i % 2], f"text {i} of {i % 7}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    folder, single = os.path.join(tmpdir_path, "folder"), os.path.join(tmpdir_path, "single")
    docs.repartition(3).write.parquet(os.path.join(folder, "documents.parquet"))
    docs.coalesce(1).write.parquet(os.path.join(tmpdir_path, "one"))
    os.mkdir(single)
    part = next(f for f in os.listdir(os.path.join(tmpdir_path, "one")) if f.endswith(".parquet"))
    os.link(os.path.join(tmpdir_path, "one", part), os.path.join(single, "documents.parquet"))
    a, b = (all_queries()[name](spark, d) for d in (folder, single))
    assert a.count() and a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_source_stream_files_grow_with_the_table(spark, tmpdir_path):
    from skein.plans.registry import all_queries
    from skein.session import checkpoint_dir
    docs = spark.createDataFrame([(i, "en", "x" * (i % 9)) for i in range(90)], "doc_id long, lang string, text string")
    root = checkpoint_dir(spark).removeprefix("file://")
    name = "spark.sql.files.openCostInBytes"
    before, folders = spark.conf.get(name), set(os.listdir(root))
    try:
        spark.conf.set(name, "128m")                       # a scan task for each file
        for n, least in ((1, 4), (9, 9)):
            sf = os.path.join(tmpdir_path, f"sf{n}")
            docs.repartition(n).write.parquet(os.path.join(sf, "documents.parquet"))
            got = all_queries()["source_stream"](spark, sf).collect()
            assert [(r.source, r.split, r.n_rows, r.n_chars) for r in got] == [("docs", "train", 90, 360)]
            new = [d for d in os.listdir(root) if d.startswith("stream-source") and d not in folders]
            folders |= set(new)
            assert len([f for f in os.listdir(os.path.join(root, new[0])) if f.endswith(".parquet")]) >= least
    finally:
        spark.conf.set(name, before)


def test_read_source_stream_and_write_eval(spark, tmpdir_path):
    base = os.path.join(tmpdir_path, "src")
    df = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "id long, text string")
    df.write.parquet(base)
    sdf = S.read_source_stream(spark, {"name": "s", "path": base}, df.schema, max_files_per_trigger=1)
    sink, ck = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck")
    sdf.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ck) \
       .trigger(availableNow=True).start().awaitTermination()
    back = spark.read.parquet(sink)
    assert back.count() == 20 and {r.source for r in back.select("source").distinct().collect()} == {"s"}
    ev = os.path.join(tmpdir_path, "eval")
    sinks.write_eval(back.filter("id < 5"), ev)
    sinks.write_eval(back.filter("id < 3"), ev)          # overwrite, not append
    assert spark.read.parquet(ev).count() == 3


def test_map_rows_and_batches(spark):
    from skein.operators import infer as U
    df = spark.createDataFrame([(i, f"w{i}") for i in range(10)], "id long, text string")
    rows = U.map_rows(df, lambda r: {"id": r["id"], "n": len(r["text"])}, "id long, n long").collect()
    assert sorted((r.id, r.n) for r in rows) == [(i, len(f"w{i}")) for i in range(10)]
    out = U.map_batches(df, lambda p: p.assign(n=p["text"].str.len())[["id", "n"]], "id long, n long",
                        partitions=3)
    assert out.rdd.getNumPartitions() == 3 and out.count() == 10


def test_worker_functions_pickled_by_value():
    # Python workers must not need the package on their path.
    import importlib
    import skein  # noqa: F401
    from pyspark.cloudpickle import cloudpickle as cp
    for name in ("skein.streaming.halting", "skein.operators.infer", "skein.operators.halting"):
        assert cp._is_registered_pickle_by_value(importlib.import_module(name))


def test_checkpoint_dir_refuses_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from skein.session import checkpoint_dir

    class Conf(dict):
        def get(self, k, d=None):
            return dict.get(self, k, d)

    sc = SimpleNamespace(master="yarn", getConf=lambda: Conf(), getCheckpointDir=lambda: None,
                         setCheckpointDir=lambda p: None)
    fake = SimpleNamespace(sparkContext=sc, conf=Conf())
    with pytest.raises(ValueError, match="shared folder"):
        checkpoint_dir(fake)
    shared = SimpleNamespace(sparkContext=sc, conf=Conf({"spark.checkpoint.dir": "hdfs:///ckpt"}))
    assert checkpoint_dir(shared) == "hdfs:///ckpt"


def test_model_is_built_once_per_worker(spark, tmp_path):
    import os
    import uuid
    from skein.operators import infer as U
    folder = str(tmp_path)

    def factory():
        open(os.path.join(folder, f"{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
        return lambda texts: [t.upper() for t in texts]

    df = spark.range(0, 400, 1, 20).selectExpr("id", "cast(id as string) AS t")
    out = U.batch_infer(df, factory, "t", ["id"]).collect()
    assert len(out) == 400
    built = [f.split("-")[0] for f in os.listdir(folder)]
    assert len(built) == len(set(built)) < 20                         # one per worker process, not per task


def test_stream_quota_and_shuffle_over_batches(spark, tmp_path):
    from skein.streaming import prepare as X
    src = str(tmp_path / "in")
    for i in range(3):
        rows = [("a" if j % 3 else None, 100 * i + j) for j in range(30)]
        spark.createDataFrame(rows, "source string, idx long").coalesce(1).write.mode("append").parquet(src)
    sdf = X.file_stream(spark, src, spark.read.parquet(src).schema, max_files_per_trigger=1)
    X.stream_quota(sdf, "source", ["idx"], 25, str(tmp_path / "q"), str(tmp_path / "c1")).awaitTermination()
    got = X.read_batches(spark, str(tmp_path / "q")).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 25, None: 25}
    X.stream_shuffle(sdf.select("idx"), ["idx"], str(tmp_path / "s"), str(tmp_path / "c2")).awaitTermination()
    pos = sorted(r.pos for r in X.read_batches(spark, str(tmp_path / "s")).collect())
    assert pos == list(range(90))
