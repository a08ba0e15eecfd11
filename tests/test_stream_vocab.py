"""Vocabulary over a stream: equals the batch vocabulary, ids stay, replays change nothing."""
import pytest

from skein.operators import tokens as T
from skein.streaming import prepare as X
from skein.streaming import vocabulary as V

TEXTS = [["b b a", None, "", "c"], ["d d d d", "a e"], [None, ""], ["e e e e e", "a", "f f a a"]]


def _df(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "text string")


def _vocab(spark, path):
    return {r["token"]: (r["id"], r["n"], r["active"]) for r in V.latest_vocab(spark, path).collect()}


def test_states_ids_and_replays(spark, tmpdir_path):
    assert _vocab(spark, tmpdir_path) == {}
    seen = {}
    for i, texts in enumerate(TEXTS):
        V.add_batch(_df(spark, texts), i, tmpdir_path, size=3)
        got = _vocab(spark, tmpdir_path)
        assert {t: v[0] for t, v in got.items() if t in seen} == seen                    # ids stay
        V.add_batch(_df(spark, texts), i, tmpdir_path, size=3)                           # replayed
        assert _vocab(spark, tmpdir_path) == got
        seen = {t: v[0] for t, v in got.items()}
        assert sorted(seen.values()) == list(range(2, 2 + len(seen)))
        want = T.build_vocab(_df(spark, [t for x in TEXTS[:i + 1] for t in x]), size=3).collect()
        assert {t: v[1] for t, v in got.items() if v[2]} == {r["token"]: r["n"] for r in want}
    assert got["b"][2] is False and got["b"][0] == 2                                      # fallen out, id kept
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        V.add_batch(_df(spark, ["x"]), 9, tmpdir_path)                                   # state of batch 8 is missing


@pytest.mark.parametrize("parts", [1, 8, 64])
def test_stream_over_files_and_a_restart(spark, tmpdir_path, parts):
    texts = [f"hot hot w{i % 17} v{i % 5}" if i % 7 else None for i in range(300)]
    src = f"{tmpdir_path}/in"

    def go(lo, hi):
        _df(spark, texts[lo:hi]).repartition(parts).coalesce(1).write.mode("append").parquet(src)
        sdf = X.file_stream(spark, src, _df(spark, []).schema, max_files_per_trigger=1)
        V.stream_vocab(sdf, f"{tmpdir_path}/v", f"{tmpdir_path}/ck", size=12).awaitTermination()

    go(0, 100)
    first = _vocab(spark, f"{tmpdir_path}/v")
    go(100, 300)
    got = _vocab(spark, f"{tmpdir_path}/v")
    assert all(got[t][0] == v[0] for t, v in first.items())
    want = T.build_vocab(_df(spark, texts), size=12).collect()
    assert {t: v[1] for t, v in got.items() if v[2]} == {r["token"]: r["n"] for r in want}
