"""A vocabulary kept up over a stream of texts.

Every micro-batch counts its tokens once and adds them to a table of exact
totals, one folder a batch: ``totals/batch_id=N`` is ``totals/batch_id=N-1`` plus the
batch. The vocabulary of batch N holds the ``size`` most frequent tokens so far
(ties by token) as active ones. A token keeps the id that it first got, also while it
is not active, so ids written by earlier batches stay true; new tokens take
the next ids in the order (count descending, token).

A replayed batch starts from its predecessor's folder again and overwrites its own, so it
changes nothing. Counts are exact, not bounded summaries: a batch costs
its own texts and one pass over the distinct tokens seen, never the texts of earlier batches. The two
newest states stay; older ones are deleted.

After the last batch the active tokens and their counts are those of ``build_vocab`` over all
texts; the ids differ wherever a token was met earlier.

Cases: null and empty texts count nothing; a batch without tokens repeats the state; repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from skein.operators.tokens import FIRST_WORD_ID, WORD_PATTERN, count_floor, token_counts
from skein.streaming.prepare import _exists

TOTALS = "token string, n long"
VOCAB = "token string, id int, n long, active boolean"


def _state(spark: SparkSession, path: str, what: str, batch_id: int) -> str:
    return f"{path.rstrip('/')}/{what}/batch_id={batch_id}"


def _read(spark: SparkSession, path: str, what: str, batch_id: int, schema: str) -> DataFrame:
    """State of a batch; before the first one it is empty. A later state that is missing is an error."""
    if batch_id < 0:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(_state(spark, path, what, batch_id))


def add_batch(batch: DataFrame, batch_id: int, path: str, text: str = "text", size: int = 8192,
              pattern: str = WORD_PATTERN) -> None:
    """Carry the state in ``path`` from batch ``batch_id`` - 1 to ``batch_id``."""
    spark = batch.sparkSession
    fresh = token_counts(batch, [], text, pattern).select("token", F.col("c").cast("long").alias("n"))
    _read(spark, path, "totals", batch_id - 1, TOTALS).unionByName(fresh) \
        .groupBy("token").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(_state(spark, path, "totals", batch_id))
    totals = _read(spark, path, "totals", batch_id, TOTALS)
    top = totals.filter(F.col("n") >= count_floor(totals, size)).orderBy(F.desc("n"), F.asc("token")).limit(size) \
        .select("token", F.lit(True).alias("now"))
    known = _read(spark, path, "vocab", batch_id - 1, VOCAB).select("token", "id")
    last = known.agg(F.max("id")).first()[0] or FIRST_WORD_ID - 1
    old = known.join(top, "token", "left")
    new = top.join(known, "token", "left_anti").join(totals, "token")
    order = Window.orderBy(F.desc("n"), F.asc("token"))                  # ``size`` new tokens at most
    new = new.select("token", (F.row_number().over(order) + F.lit(last)).cast("int").alias("id"), "now")
    every = old.select("token", "id", "now").unionByName(new)
    every.join(totals, "token").select("token", "id", "n", F.coalesce("now", F.lit(False)).alias("active")) \
        .write.mode("overwrite").parquet(_state(spark, path, "vocab", batch_id))
    for what in ("totals", "vocab"):
        _forget(spark, _state(spark, path, what, batch_id - 2))


def _forget(spark: SparkSession, path: str) -> None:
    if _exists(spark, path):
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stream_vocab(sdf: DataFrame, path: str, ckpt: str, text: str = "text", size: int = 8192,
                 pattern: str = WORD_PATTERN) -> StreamingQuery:
    """Keep the vocabulary in ``path`` up with a stream; ``latest_vocab`` reads it."""
    def run(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, batch_id, path, text, size, pattern)

    return sdf.writeStream.foreachBatch(run).option("checkpointLocation", ckpt).trigger(availableNow=True).start()


def latest_vocab(spark: SparkSession, path: str) -> DataFrame:
    """(token, id, n, active) after the last batch; empty before the first."""
    if not _exists(spark, f"{path.rstrip('/')}/vocab"):
        return spark.createDataFrame([], VOCAB)
    every = spark.read.schema(f"{VOCAB}, batch_id int").parquet(f"{path.rstrip('/')}/vocab")
    last = every.agg(F.max("batch_id")).first()[0]
    if last is None:                                   # batches without a token
        return spark.createDataFrame([], VOCAB)
    return _read(spark, path, "vocab", last, VOCAB)
