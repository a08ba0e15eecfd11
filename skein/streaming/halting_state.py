"""Online halting with the engine's own state.

Two numbers a sequence (rank so far, steps since the last halt) live in the
RocksDB state store and are part of the stream's checkpoint. The new steps of a
trigger come as an iterator of batches; of each only the numbers are kept (an
index of the sort key and the signal), results leave ``rows`` at a time, so a sequence with a
third of all steps is never one frame of strings and objects. Its numbers, 33 bytes a
step, are held for the trigger: ``max_files_per_trigger`` bounds them.

Steps are taken in the order (ts_us, event_id) within a trigger; across triggers the earlier
one comes first, as in ``stream_halting``, and both give the same rows.

Cases: a null sequence is a sequence of its own; a null signal value never halts early; steps with equal order keys
come in any order among themselves, which shows in their event_id alone if they are repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from skein.operators.halting import prefix_maps
from skein.streaming.halting import OUT_SCHEMA, _min_halt
from skein.streaming.quota import use_state_store

ROWS = 65_536


def take_steps(seq_id, ts, event, sig, rank: int, steps: int, max_steps: int, act: bool, explore_p: float, seed: int,
               rows: int = ROWS) -> Iterator[tuple[pd.DataFrame, int, int]]:
    """Result frames of at most ``rows`` steps, in order, each with the state after it."""
    order = np.lexsort((event, ts))
    for lo in range(0, len(order), rows):
        at = order[lo:lo + rows]
        n = len(at)
        ranks = np.arange(rank + 1, rank + n + 1, dtype=np.int64)
        if act:
            mins = _min_halt(seed, seq_id, ranks, explore_p, max_steps)
            after = prefix_maps(sig[at], mins, np.arange(n) == 0, max_steps)[0][:, steps]
            step = np.append(steps, after[:-1]) + 1
            halted = (step >= max_steps) | (sig[at] & (step >= mins))
        else:
            step = (steps + np.arange(n)) % max_steps + 1
            halted = step >= max_steps
        rank, steps = int(ranks[-1]), 0 if halted[-1] else int(step[-1])
        yield pd.DataFrame({"seq_id": pd.Series([seq_id] * n, dtype="Int64"), "event_id": event[at], "rank": ranks,
                            "step": step.astype(np.int32), "halted": halted}), rank, steps


def halting_processor(max_steps: int, training: bool, explore_p: float, seed: int) -> StatefulProcessor:
    act = training and max_steps > 1

    class Halting(StatefulProcessor):
        def init(self, handle) -> None:
            self.state = handle.getValueState("counter", "rank long, steps int")

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            ts, event, sig = [], [], []
            for f in rows:
                ts.append(f["ts_us"].to_numpy(np.int64))
                event.append(f["event_id"].to_numpy(np.int64))
                sig.append((f["q_halt"].to_numpy(np.float64) > f["q_continue"].to_numpy(np.float64)))
            if not ts:
                return
            seq_id = None if key[0] == "" else int(key[0])
            rank, steps = self.state.get() if self.state.exists() else (0, 0)
            for frame, rank, steps in take_steps(seq_id, np.concatenate(ts), np.concatenate(event), np.concatenate(sig),
                                                 rank, steps, max_steps, act, explore_p, seed):
                yield frame
            self.state.update((rank, steps))

        def close(self) -> None:
            pass

    return Halting()


def stream_halting_state(sdf: DataFrame, max_steps: int = 8, training: bool = True, explore_p: float = 0.0,
                         seed: int = 42) -> DataFrame:
    """(seq_id, event_id, rank, step, halted) of a stream of (seq_id, ts_us, event_id, q_halt, q_continue)."""
    if sdf.isStreaming:
        use_state_store(sdf.sparkSession)
    rows = sdf.select(F.coalesce(F.col("seq_id").cast("string"), F.lit("")).alias("_skein_seq"), "ts_us", "event_id",
                      "q_halt", "q_continue")
    return rows.groupBy("_skein_seq").transformWithStateInPandas(
        halting_processor(max_steps, training, explore_p, seed), outputStructType=OUT_SCHEMA, outputMode="Append",
        timeMode="None")
