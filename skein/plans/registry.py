"""Query catalogue: name -> (Spark builder, DuckDB oracle SQL or None).

A builder takes (spark, sf_dir) and returns a lazy DataFrame that reads the
driver tables. Oracle SQL, when given, must return the same columns (names,
types) and rows on DuckDB, where every table is a pre-registered view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def all_queries() -> dict[str, Builder]:
    _import_all()
    return dict(QUERIES)


def all_oracles() -> dict[str, str]:
    _import_all()
    return dict(ORACLE)


def _import_all() -> None:
    # Importing the modules registers their queries.
    from skein.plans import (q_tokens, q_format, q_sampling, q_mixing, q_scoring,  # noqa: F401
                             q_halting, q_vectors, q_runlog, q_streams, q_lifecycle, q_sources)
