"""Window form equals the sequential rule."""
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from skein.operators import halting as W


def _reference(rows, max_steps, training):
    out, steps = [], 0
    for i, (qh, qc) in enumerate(rows):
        steps += 1
        h = steps >= max_steps or (training and max_steps > 1 and qh > qc)
        out.append((i + 1, steps, h))
        if h:
            steps = 0
    return out


def _log(spark, seqs):
    rows = [(s, t, t, qh, qc) for s, seq in seqs.items() for t, (qh, qc) in enumerate(seq)]
    return spark.createDataFrame(rows, "seq_id long, ts_us long, event_id long, q_halt double, q_continue double")


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from([-1.0, 0.0, 1.0]), st.sampled_from([-1.0, 0.0, 1.0])),
                min_size=1, max_size=30), st.integers(1, 5), st.booleans())
def test_window_rule_equals_sequential(spark, seq, max_steps, training):
    got = W.halt_steps(_log(spark, {7: seq}), ["ts_us", "event_id"], max_steps, training).collect()
    got = sorted((r.rank, r.step, r.halted) for r in got)
    assert got == _reference(seq, max_steps, training)


def test_equal_logits_do_not_halt_and_targets(spark):
    seq = [(0.5, 0.5), (0.5, 0.5), (2.0, 0.0)]
    st_ = W.halt_steps(_log(spark, {1: seq}), ["ts_us", "event_id"], 8, True)
    rows = sorted(W.halt_targets(st_, 8).collect(), key=lambda r: r.rank)
    assert [r.halted for r in rows] == [False, False, True]
    assert rows[-1].target_q_continue is None            # no log row after the last step
    state = W.halt_state(W.halt_targets(st_, 8)).first()
    assert state.halted and state.steps == 3


def test_hot_sequence_many_buckets(spark):
    rnd = random.Random(1)
    seq = [(rnd.choice([0.0, 1.0]), 0.5) for _ in range(300)]
    got = W.halt_steps(_log(spark, {1: seq, 2: seq[:5]}), ["ts_us", "event_id"], 4, True).filter("seq_id = 1")
    assert sorted((r.rank, r.step, r.halted) for r in got.collect()) == _reference(seq, 4, True)


def test_stream_halting_equals_batch(spark, tmpdir_path):
    import os
    from skein.streaming.halting import stream_halting
    rnd = random.Random(2)
    seqs = {s: [(rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(rnd.randint(1, 20))] for s in range(6)}
    src = os.path.join(tmpdir_path, "src")
    _log(spark, seqs).write.parquet(src)
    schema = spark.read.parquet(src).schema
    sdf = spark.readStream.schema(schema).parquet(src)
    sink, ck = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck")
    stream_halting(sdf, 4, True).writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    a = spark.read.parquet(sink).select("seq_id", "event_id", "rank", "step", "halted")
    b = W.halt_steps(_log(spark, seqs), ["ts_us", "event_id"], 4, True).select(
        "seq_id", "event_id", "rank", "step", "halted")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _reference_explore(seq_id, rows, max_steps, p, seed=42):
    import hashlib

    def u(tag, r):
        return int(hashlib.md5(f"{seed}:{tag}:{seq_id}:{r}".encode()).hexdigest()[:8], 16) / 4294967296.0

    out, steps = [], 0
    for i, (qh, qc) in enumerate(rows):
        rank = i + 1
        mn = 2 + int(u("b", rank) * (max_steps - 1)) if u("a", rank) < p else 0
        steps += 1
        h = steps >= max_steps or (qh > qc and steps >= mn)
        out.append((rank, steps, h))
        if h:
            steps = 0
    return out


def test_explore_chunks_equal_sequential_and_stream(spark, tmpdir_path):
    import os
    from skein.streaming.halting import stream_halting
    rnd = random.Random(5)
    seqs = {s: [(rnd.uniform(-1, 1), rnd.uniform(-1, 1)) for _ in range(rnd.randint(1, 40))] for s in range(4)}
    got = W.halt_steps_explore(_log(spark, seqs), ["ts_us", "event_id"], 5, 0.5, chunk_rows=7).collect()
    for s, rows in seqs.items():
        mine = sorted((r.rank, r.step, r.halted) for r in got if r.seq_id == s)
        assert mine == _reference_explore(s, rows, 5, 0.5)
    src = os.path.join(tmpdir_path, "src")
    _log(spark, seqs).write.parquet(src)
    sdf = spark.readStream.schema(spark.read.parquet(src).schema).parquet(src)
    sink, ck = os.path.join(tmpdir_path, "sink"), os.path.join(tmpdir_path, "ck")
    stream_halting(sdf, 5, True, explore_p=0.5).writeStream.format("parquet").option("path", sink) \
        .option("checkpointLocation", ck).trigger(availableNow=True).start().awaitTermination()
    a = {(r.seq_id, r.rank, r.step, r.halted) for r in spark.read.parquet(sink).collect()}
    assert a == {(r.seq_id, r.rank, r.step, r.halted) for r in got}
