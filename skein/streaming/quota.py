"""Quota per source with the engine's own state.

One value a source, the number of rows taken, lives in the RocksDB state store
and is part of the stream's checkpoint: no side table is read, and a restarted
query goes on where it stopped. A source's rows of one trigger come as an
iterator of batches of which only the rows that may still be taken are held, so a source with
a third of all rows never becomes one frame. A source whose quota is full costs
no more than its rows' way to the operator.

Within a trigger the rows of least ``by`` are taken (NULLs first); across triggers the
earlier one comes first. Null sources are a source of their own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(spark: SparkSession) -> None:
    """Streams started from now on keep their state in RocksDB (needed for ``stream_quota_state``)."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def least_rows(frames: Iterator[pd.DataFrame], by: Sequence[str], n: int) -> pd.DataFrame | None:
    """The ``n`` rows of least ``by`` over all frames, holding 2 n rows and a frame at most."""
    held, parts, size = None, [], 0
    for f in frames:
        if n <= 0 or not len(f):
            continue
        parts.append(f.sort_values(list(by), kind="stable", na_position="first").head(n))
        size += len(parts[-1])
        if size > n:
            held = pd.concat(parts).sort_values(list(by), kind="stable", na_position="first").head(n)
            parts, size = [held], len(held)
    if not parts:
        return None
    return pd.concat(parts).sort_values(list(by), kind="stable", na_position="first").head(n)


def quota_processor(by: Sequence[str], q: int) -> StatefulProcessor:
    class Quota(StatefulProcessor):
        def init(self, handle) -> None:
            self.taken = handle.getValueState("taken", "n long")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            seen = self.taken.get()[0] if self.taken.exists() else 0
            out = least_rows(rows, by, q - seen)
            if out is not None:
                self.taken.update((seen + len(out),))
                yield out

        def close(self) -> None:
            pass

    return Quota()


def stream_quota_state(sdf: DataFrame, source: str, by: Sequence[str], q: int) -> DataFrame:
    """The first ``q`` rows of each source of a stream, as a streaming DataFrame (append mode)."""
    if sdf.isStreaming:
        use_state_store(sdf.sparkSession)
    return sdf.withColumn("_skein_src", F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))) \
        .groupBy("_skein_src").transformWithStateInPandas(
            quota_processor(by, q), outputStructType=sdf.schema, outputMode="Append", timeMode="None")
