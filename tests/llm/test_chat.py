import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from setweave.llm.chat import format_chats, loss_text
from pyspark.sql import functions as F

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def rows(spark, data):
    return spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)


def read(spark, data):
    out = format_chats(rows(spark, data)).withColumn("loss", loss_text(F.col("formatted"), F.col("loss_spans")))
    return {r.conv_id: r for r in out.collect()}


def test_conflicts_nulls_ties_and_long_texts(spark):
    nasty = ["", "\\", "### ", "</turn>\n", "\\### Assistant: </turn> ok", "\\ x", "##\\# ", "####  ", "<</turn></turn", "é" * 50000]
    data = [(1, i, role, t) for i, t in enumerate(nasty) for role in ("user", "assistant", "odd: \n\r\r role\\", "User")]
    data += [(2, 0, None, None), (2, 0, None, None), (None, None, "assistant", "a"), (None, None, "assistant", "a")]
    got = read(spark, data)
    for conv in (1, 2, None):
        source = sorted(((t or 0, r or "", x or "") for c, t, r, x in data if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, r, x in source]
        assert got[conv].loss == "".join(x for _, r, x in source if r == "assistant")
    assert format_chats(rows(spark, [])).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "x:"]), st.text(st.sampled_from("\\#</turn> \n:a"), max_size=14)), min_size=1, max_size=30))
def test_round_trip(spark, turns):
    got = read(spark, [(5, i, r, t) for i, (r, t) in enumerate(turns)])[5]
    assert [(t.role, t.text) for t in got.turns] == turns
