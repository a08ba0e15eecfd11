"""Corpus pipeline over ``documents``: five stages, each by one operator of ``skein.llm``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is
written as Parquet and read again as the next stage's documents; all but the
last keep the columns of ``documents``.

1. language: texts without a recognisable language go; a null lang is filled.
2. near_duplicates: of each group of near copies the row of the smallest doc_id stays.
3. secrets: findings are replaced in the text, n_chars follows; no row goes.
4. mixing: documents of poor and toxic domains are thinned to their target
   token shares next to the good domain, whose documents keep rate 1 and stay.
5. packing: pieces of token windows.

Cases (null, empty and very long texts, repeated rows, empty tables, further columns) are
those of the operators; a null doc_id is an id like any other.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import langid, mixing, ngramjoin, packing, secrets
from skein.llm.queries import MIX_WEIGHTS, fold_of, vocabulary
from skein.llm.scratch import save

LEAST_SCORE = 0.3          # share of a text's n-grams that its language must know


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows of a learned language; null and letterless texts go. Learns from docs with a lang, but for a fold."""
    model = langid.fit(docs.filter(fold_of() != 2))
    seen = langid.identify(docs, model).filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return seen.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Decides row by row: of each group of linked texts, and of exact repeats, the row of smallest doc_id stays (null
    last; of equal doc_ids the first row). Empty texts link with nothing and stay."""
    rid = "_rid"
    while rid in docs.columns:
        rid += "_"
    rows = save(docs.withColumn(rid, F.monotonically_increasing_id()), "stage-rows")        # numbers that stay the same
    groups = ngramjoin.join_texts(rows, rid).select(rid, "component_id").join(rows.select(rid, F.col("doc_id").alias("id")), rid)
    keep = groups.groupBy("component_id").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", rid)).alias("r")) \
        .select(F.col(f"r.{rid}").alias(rid))
    return rows.join(keep, rid, "left_semi").select(*docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every row; findings in the text are masked, a null text stays null."""
    clean = secrets.redact(docs, secrets.fit(docs))
    return clean.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thins poor and toxic documents; a row is drawn by its doc_id, so repeated ids stay or go by their own rates."""
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    return mixing.thin(docs, labels, MIX_WEIGHTS)[0]


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of 4,096-token windows of every row; a null text is its end token alone."""
    return packing.pack(docs, vocabulary()).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("secrets", secret_scan),
          ("mixing", mix_sources), ("packing", pack)]
ORACLE_SQL = None          # the classifiers and the tokenizer are not SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = save(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
