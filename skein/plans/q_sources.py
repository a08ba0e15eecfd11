"""Queries for source specs, sinks and Python map forms.

Each query first lays a driver table out as the source needs it (directories,
globs, formats, splits) under the shared checkpoint folder, with Spark, and
then reads all of it back through the operator.
"""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import functions as F

from skein.operators import infer as U
from skein.operators import sampling as L
from skein.operators.formatting import resolve_text
from skein.plans.derive import RUN_METRICS_SQL, run_metrics, sources
from skein.plans.q_sampling import LARGE_Q, MIX_SPECS
from skein.plans.registry import ORACLE, load, register
from skein.sources import sinks
from skein.sources.readers import read_mix, read_source, read_source_stream
from skein.streaming import prepare as X

SHARDS = 4


def _docs(spark, sf):
    return load(spark, sf, "documents").select("doc_id", "lang", "text")


def _totals(df, *by):
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"),
                               F.sum(F.length("text")).cast("bigint").alias("n_chars"))


def source_config(spark, sf):
    """One sub-directory per named config, each read by ``config``; M5 over the mix."""
    base = X.scratch(spark, "configs")
    docs = _docs(spark, sf)
    names = [s["name"] for s in MIX_SPECS]
    for name in names:
        docs.filter(F.col("lang") == name).write.parquet(os.path.join(base, name))
    specs = [{"name": f"docs-{n}", "path": base, "config": n} for n in names]
    return _totals(read_mix(spark, specs, columns=["doc_id", "text"]), "source", "split")


register("source_config", """
SELECT 'docs-' || lang AS source, 'train' AS split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents GROUP BY lang
""")(source_config)


def source_globs(spark, sf):
    """S3: a source is a list of file globs; two sources share one directory."""
    base = X.scratch(spark, "globs")
    docs = _docs(spark, sf)
    for i in range(SHARDS):
        docs.filter(F.col("doc_id") % SHARDS == i).write.parquet(os.path.join(base, f"shard{i}"))
    even = {"name": "even", "path": base, "data_files": ["shard0/*.parquet", "shard2/*.parquet"]}
    odd = {"name": "odd", "path": base, "data_files": "shard[13]/*.parquet"}
    return _totals(read_mix(spark, [even, odd], columns=["doc_id", "text"]), "source")


register("source_globs", f"""
SELECT CASE WHEN doc_id % {SHARDS} % 2 = 0 THEN 'even' ELSE 'odd' END AS source, count(*) AS n_rows,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents GROUP BY ALL
""")(source_globs)


def source_formats(spark, sf):
    """JSON lines and plain text lines, both resolved to a text column."""
    base = X.scratch(spark, "formats")
    load(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("content")) \
        .write.json(os.path.join(base, "json"))
    load(spark, sf, "benchmark").select(F.regexp_replace("text", r"[\r\n]", " ").alias("value")) \
        .write.text(os.path.join(base, "text"))
    json = resolve_text(read_source(spark, {"name": "json", "path": os.path.join(base, "json"), "format": "json"}))
    text = read_source(spark, {"name": "text", "path": os.path.join(base, "text"), "format": "text"})
    return _totals(json.select("source", "text").unionByName(
        text.select("source", F.col("value").alias("text"))), "source")


register("source_formats", """
SELECT 'json' AS source, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations
UNION ALL SELECT 'text', count(*), CAST(sum(length(text)) AS BIGINT) FROM benchmark
""")(source_formats)


def split_select(spark, sf):
    """Splits as partition directories; one read by spec, one selected after reading both."""
    base = X.scratch(spark, "splits")
    split = F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")
    _docs(spark, sf).withColumn("split", split).write.partitionBy("split").parquet(base)
    by_spec = read_source(spark, {"name": "by_spec", "path": base}, "validation").select("source", "split", "doc_id", "text")
    after = L.select_split(spark.read.parquet(base), "train").select(
        F.lit("after").alias("source"), "split", "doc_id", "text")
    return _totals(by_spec.unionByName(after), "source", "split")


register("split_select", """
SELECT CASE WHEN doc_id % 10 = 0 THEN 'by_spec' ELSE 'after' END AS source,
       CASE WHEN doc_id % 10 = 0 THEN 'validation' ELSE 'train' END AS split, count(*) AS n_rows,
       CAST(sum(length(text)) AS BIGINT) AS n_chars
FROM documents GROUP BY ALL
""")(split_select)


def source_stream(spark, sf):
    """S5 in its spec form: the files of one split as a stream of several micro-batches. A file holds what one
    task of the scan reads; only a table of fewer tasks is dealt to ``SHARDS`` files."""
    base = X.scratch(spark, "stream-source")
    docs = _docs(spark, sf)
    (docs if docs.rdd.getNumPartitions() >= SHARDS else docs.repartition(SHARDS, "doc_id")).write.parquet(base)
    files = -(-len(spark.read.parquet(base).inputFiles()) // SHARDS)
    sdf = read_source_stream(spark, {"name": "docs", "path": base}, docs.schema, max_files_per_trigger=files)
    sink, ckpt = X.scratch(spark, "stream-sink"), X.scratch(spark, "ckpt")
    sdf.writeStream.format("parquet").option("path", sink).option("checkpointLocation", ckpt) \
       .trigger(availableNow=True).start().awaitTermination()
    return _totals(spark.read.parquet(sink), "source", "split")


register("source_stream", """
SELECT 'docs' AS source, 'train' AS split, count(*) AS n_rows, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents
""")(source_stream)


def eval_sink(spark, sf):
    """The eval rows of the default size written as a table and read back."""
    path = X.scratch(spark, "eval")
    src = sources(spark, sf).select("source", "idx", "text")
    sinks.write_eval(L.eval_quota(src, "source", ["idx"], LARGE_Q), path)
    return spark.read.parquet(path).select("source", "idx", F.length("text").alias("n_chars"))


register("eval_sink", f"""
WITH r AS (SELECT lang AS source, doc_id AS idx, CAST(length(text) AS INTEGER) AS n_chars,
                  row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents)
SELECT source, idx, n_chars FROM r WHERE rn <= {LARGE_Q}
""")(eval_sink)


def metrics_log(spark, sf):
    """Two appends to one metrics table, read back by metric."""
    path = X.scratch(spark, "metrics")
    loss = run_metrics(spark, sf)
    sinks.append_metrics(loss, path)
    sinks.append_metrics(loss.withColumn("metric", F.lit("perplexity")).withColumn("value", F.exp("value")), path)
    return spark.read.parquet(path).groupBy("run_id", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.round(F.max("value"), 6).alias("top"))


register("metrics_log", f"""
WITH {RUN_METRICS_SQL},
b AS (SELECT * FROM run_metrics UNION ALL SELECT run_id, step, 'perplexity', exp(value) FROM run_metrics)
SELECT run_id, metric, count(*) AS n, min(step) AS first_step, max(step) AS last_step, round(max(value), 6) AS top
FROM b GROUP BY run_id, metric
""")(metrics_log)


def metrics_rerun(spark, sf):
    """S11 with a job that runs again: the second write of an id replaces the first."""
    path = X.scratch(spark, "metrics-rerun")
    loss = run_metrics(spark, sf)
    sinks.put_metrics(loss.filter("step % 3 = 0"), path, "loss")            # broken off, then run again
    sinks.put_metrics(loss, path, "loss")
    both = loss.withColumn("metric", F.lit("perplexity")).withColumn("value", F.exp("value"))
    sinks.put_metrics(both.unionByName(both), path, "perplexity")
    sinks.put_metrics(loss, path, "loss")
    return spark.read.parquet(path).groupBy("run_id", "metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("step").alias("first_step"), F.max("step").alias("last_step"),
        F.round(F.max("value"), 6).alias("top"))


register("metrics_rerun", ORACLE["metrics_log"])(metrics_rerun)


def map_rows_q(spark, sf):
    """A Python function of one row over whole texts."""
    def fn(row):
        return {"doc_id": row["doc_id"], "n_chars": len(row["text"]), "n_lines": row["text"].count("\n") + 1}

    return U.map_rows(_docs(spark, sf), fn, "doc_id long, n_chars long, n_lines long")


_MAP_SQL = """
SELECT doc_id, length(text) AS n_chars, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS BIGINT) AS n_lines
FROM documents
"""
register("map_rows", _MAP_SQL)(map_rows_q)


def map_batches_q(spark, sf):
    """The same per Arrow batch, over eight tasks; other columns are dropped."""
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pdf["doc_id"], "n_chars": pdf["text"].str.len(),
                             "n_lines": pdf["text"].str.count("\n") + 1})

    return U.map_batches(_docs(spark, sf), fn, "doc_id long, n_chars long, n_lines long", partitions=8)


register("map_batches", _MAP_SQL)(map_batches_q)
