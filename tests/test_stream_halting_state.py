"""X5 on the state store: many triggers, a restart, a hot and a null sequence, exploration, blocks of results."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.streaming import halting_state as H
from skein.streaming.halting import _min_halt

SCHEMA = "seq_id long, ts_us long, event_id long, q_halt double, q_continue double"


def _plain(steps, max_steps, training, p, seed):
    """One loop over each sequence."""
    out, state = [], {}
    for s, _, e, h, c in sorted(steps, key=lambda r: (r[1], r[2])):
        rank, step = state.get(s, (0, 0))
        rank, step = rank + 1, step + 1
        least = int(_min_halt(seed, s, np.array([rank]), p, max_steps)[0])
        halted = step >= max_steps or (training and h is not None and c is not None and h > c and step >= least)
        out.append((s, e, rank, step, halted))
        state[s] = (rank, 0 if halted else step)
    return sorted(out, key=repr)


def _steps(n):
    return [((1 if i % 3 == 0 else None if i % 7 == 0 else 2 + i % 11), 10 * (i // 2), i,
             None if i % 13 == 0 else (i * 37 % 19) / 19, 0.7) for i in range(n)]


@pytest.mark.parametrize("training,p", [(True, 0.0), (True, 0.5), (False, 0.0)])
def test_state_over_triggers_and_a_restart(spark, tmpdir_path, training, p):
    name = "spark.sql.streaming.stateStore.providerClass"
    before, steps = spark.conf.get(name, None), _steps(400)
    want = _plain(steps, 5, training, p, 42)

    def go(*cuts):
        for lo, hi in cuts:
            spark.createDataFrame(steps[lo:hi], SCHEMA).orderBy(F.desc("event_id")).coalesce(1) \
                 .write.mode("append").parquet(f"{tmpdir_path}/in")
        sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{tmpdir_path}/in")
        H.stream_halting_state(sdf, 5, training, p).writeStream.format("parquet").option("path", f"{tmpdir_path}/out") \
         .option("checkpointLocation", f"{tmpdir_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return sorted((tuple(r) for r in spark.read.parquet(f"{tmpdir_path}/out")
                       .select("seq_id", "event_id", "rank", "step", "halted").collect()), key=repr)

    try:
        go((0, 80), (80, 200))
        assert go((200, 400)) == want
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def test_blocks_of_results_pass_the_state_on():
    rng = np.random.default_rng(1)
    ts, event, sig = rng.integers(0, 50, 500), np.arange(500), rng.random(500) < 0.3
    whole = next(H.take_steps(3, ts, event, sig, 4, 2, 6, True, 0.4, 7))[0]
    parts = [f for f, _, _ in H.take_steps(3, ts, event, sig, 4, 2, 6, True, 0.4, 7, rows=37)]
    assert max(map(len, parts)) == 37 and [x for f in parts for x in f.itertuples(index=False)] == list(whole.itertuples(index=False))
    assert list(H.take_steps(3, ts[:0], event[:0], sig[:0], 0, 0, 6, True, 0.4, 7)) == []
