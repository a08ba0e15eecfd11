"""Online halting over a step stream.

State per sequence: (rank so far, steps since the last halt). Each
micro-batch brings some new steps per sequence; they are processed in order
with the halting rule (halt at max steps; in training also when q_halt >
q_continue, subject to the exploration minimum), results are emitted at once
(append), and the state keeps the counters. A group in a micro-batch holds
only that sequence's new rows, so its size is bounded by the trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from skein.operators.halting import prefix_maps

OUT_SCHEMA = "seq_id long, event_id long, rank long, step int, halted boolean"
STATE_SCHEMA = "rank long, steps int"


def _min_halt(seed: int, seq_id: int, rank: np.ndarray, p: float, max_steps: int) -> np.ndarray:
    """Exploration minimum per step from md5(seed:seq:rank), same draw as the
    batch operator: u < p -> uniform integer in [2, max_steps], else 0."""
    import hashlib
    out = np.zeros(len(rank), dtype=np.int64)
    if p <= 0:
        return out
    for i, r in enumerate(rank):
        a = int(hashlib.md5(f"{seed}:a:{seq_id}:{r}".encode()).hexdigest()[:8], 16) / 4294967296.0
        if a < p:
            b = int(hashlib.md5(f"{seed}:b:{seq_id}:{r}".encode()).hexdigest()[:8], 16) / 4294967296.0
            out[i] = 2 + int(b * (max_steps - 1))
    return out


def make_halting_fn(max_steps: int = 8, training: bool = True, explore_p: float = 0.0, seed: int = 42):
    act = training and max_steps > 1

    def fn(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq_id = int(key[0])
        rank, steps = state.get if state.exists else (0, 0)
        frames = [p for p in pdfs if len(p)]
        if not frames:
            return
        pdf = pd.concat(frames).sort_values(["ts_us", "event_id"], kind="stable")
        n = len(pdf)
        ranks = np.arange(rank + 1, rank + n + 1, dtype=np.int64)
        sig = (pdf["q_halt"].to_numpy() > pdf["q_continue"].to_numpy())
        mins = _min_halt(seed, seq_id, ranks, explore_p, max_steps) if act else np.zeros(n, dtype=np.int64)
        if act:
            first = np.zeros(n, bool)
            first[0] = True
            after = prefix_maps(sig, mins, first, max_steps)[0][:, steps]
            out_step = np.append(steps, after[:-1]) + 1
            out_halt = (out_step >= max_steps) | (sig & (out_step >= mins))
        else:
            out_step = (steps + np.arange(n)) % max_steps + 1
            out_halt = out_step >= max_steps
        steps = 0 if out_halt[-1] else int(out_step[-1])
        state.update((int(ranks[-1]), int(steps)))
        yield pd.DataFrame({"seq_id": seq_id, "event_id": pdf["event_id"].to_numpy(), "rank": ranks,
                            "step": out_step.astype(np.int32), "halted": out_halt})

    return fn


def stream_halting(sdf: DataFrame, max_steps: int = 8, training: bool = True, explore_p: float = 0.0,
                   seed: int = 42) -> DataFrame:
    """Streaming DataFrame of (seq_id, event_id, rank, step, halted).

    ``sdf`` needs seq_id, ts_us, event_id, q_halt, q_continue."""
    return sdf.groupBy("seq_id").applyInPandasWithState(
        make_halting_fn(max_steps, training, explore_p, seed), OUT_SCHEMA, STATE_SCHEMA, "append",
        GroupStateTimeout.NoTimeout)
