"""P1-P7, F1 on hand-made edge rows."""
import pytest
from pyspark.sql import functions as F

from skein.operators import formatting as P


def test_instruction_template_edge_inputs(spark):
    rows = [(1, "do", None, "ok"), (2, "do", "", "ok"), (3, "do", "  ", "ok"), (4, "do", "x", "ok"),
            (5, None, None, None)]
    df = spark.createDataFrame(rows, "id int, instruction string, input string, output string")
    got = {r.id: r.text for r in P.format_instruction(df).collect()}
    short = "### Instruction:\ndo\n\n### Response:\nok"
    assert got[1] == short and got[2] == short
    assert got[3] == "### Instruction:\ndo\n\n### Input:\n  \n\n### Response:\nok"  # whitespace counts
    assert got[4] == "### Instruction:\ndo\n\n### Input:\nx\n\n### Response:\nok"
    assert got[5] == "### Instruction:\n\n\n### Response:\n"


def test_instruction_template_missing_input_column(spark):
    df = spark.createDataFrame([("a", "b")], "instruction string, output string")
    assert P.format_instruction(df).first().text == "### Instruction:\na\n\n### Response:\nb"


def test_conversation_capitalize_and_order(spark):
    df = spark.createDataFrame([(1, 1, "ASSISTANT", "hi"), (1, 0, "user", "hello"), (2, 0, "sYstem", "s")],
                               "conv_id int, turn int, role string, text string")
    got = {r.conv_id: r.text for r in P.format_conversation(df).collect()}
    assert got == {1: "User: hello\nAssistant: hi", 2: "System: s"}


def test_wrap_prompt_and_drop_blank(spark):
    df = spark.createDataFrame([("### done",), ("bare",), ("   ",), (None,), ("\n",)], "p string")
    got = [r.w for r in P.drop_blank(df, "p").select(P.wrap_prompt("p").alias("w")).collect()]
    assert sorted(got) == sorted(["### done", "### Instruction:\nbare\n\n### Response:\n"])


def test_resolve_text_modes(spark):
    inst = spark.createDataFrame([("i", "o")], "instruction string, output string")
    assert P.resolve_text(inst).first().text == "i"  # reference: output dropped
    assert P.resolve_text(inst, mode="combine").first().text == "i\n\no"
    content = spark.createDataFrame([("c", "i")], "content string, instruction string")
    assert P.resolve_text(content).first().text == "c"
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    with pytest.raises(ValueError, match="is a column of"):
        P.resolve_text(pages)


def test_preview(spark):
    df = spark.createDataFrame([("abcdef",), ("abc",)], "t string")
    got = [tuple(r) for r in df.select(P.preview("t", 3), P.preview("t", 3, always=True)).collect()]
    assert got == [("abc...", "abc..."), ("abc", "abc...")]
