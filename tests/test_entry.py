"""Driver contract: entry(), queries() and oracle_sql() agree at sf0.001."""
import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, rows_of

SF = "/root/testdata/sf0.001"
FAST = ["corpus_token_stats", "format_instruction", "eval_set", "pack_grouped", "interleave_exhausted",
        "halt_steps_train", "seq_accuracy_rollup", "early_stop", "sign_update", "stream_halting"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) >= 1 and "n_tokens" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = E.queries()[name](spark, SF)
    rel = con.execute(E.oracle_sql()[name])
    a = rows_of(df.columns, [tuple(r) for r in df.collect()])
    b = rows_of([d[0] for d in rel.description], rel.fetchall())
    assert a == b
