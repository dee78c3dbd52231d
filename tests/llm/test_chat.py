"""Chat formatting against plain Python, and round trips of texts that hold the template's own marks."""

import hashlib

import pytest
from hypothesis import Phase, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.llm import chat
from spanwise.llm.common import table
from tests.llm.helpers import rows

SCHEMA = "conv_id long, turn long, role string, text string"
MARKS = [m for t in chat.INSTRUCT.turns for m in (t.opening, t.closing)] + list(chat.OTHER) + [x for e in chat.ESCAPES for x in e]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(turns):
    """What the digests must be, from (role, text) in order."""
    learned = "".join(t for r, t in turns if r == "assistant")
    return {"n_turns": len(turns), "turns_sha256": sha("".join(f"{r}\n{t}\n" for r, t in turns)), "loss_chars": len(learned), "loss_sha256": sha(learned)}


def walk(roles):
    """Whether the order is legal, whether it is complete, and the first wrong position, told by cases."""
    for i, role in enumerate(roles):
        before = roles[i - 1] if i else None
        legal = {"system": before is None, "user": before in (None, "system", "assistant"), "assistant": before == "user"}.get(role, False)
        if not legal:
            return False, False, i
    return True, bool(roles) and roles[-1] == "assistant", None


def check(spark, conversations):
    data = [(c, i, r, t) for c, turns in conversations.items() for i, (r, t) in enumerate(turns)]
    got = {r["conv_id"]: r for r in rows(chat.chat_digests(spark.createDataFrame(data, SCHEMA)))}
    assert set(got) == {c for c, turns in conversations.items() if turns}
    for c, r in got.items():
        turns = [(a or "", b or "") for a, b in conversations[c]]
        assert {k: r[k] for k in plain(turns)} == plain(turns)
        assert (r["valid"], r["complete"], r["wrong_turn"]) == walk([a for a, _ in turns])


pieces = st.lists(st.sampled_from([*MARKS, "a", " ", "\n", "\\", "[", "<", "]", ">", "/", "INST", "é", "😀"]), max_size=8).map("".join)
turn = st.tuples(st.one_of(st.sampled_from(["system", "user", "assistant"]), pieces), pieces)


@settings(max_examples=4, deadline=None, phases=[Phase.generate])  # an example is a Spark job, too slow to shrink
@given(st.lists(st.lists(turn, max_size=6), min_size=60, max_size=60))
def test_texts_made_of_marks_come_back(spark, many):
    check(spark, dict(enumerate(many)))


def test_edge_rows(spark):
    check(spark, {1: [("user", None), ("assistant", "")], 2: [(None, "x"), ("tool", None)], None: [("user", "q")], 4: [("user", "[<\\" * 50_000), ("assistant", "word " * 200_000)], 5: [("assistant", "a")] * 3})


def test_ties_repeats_and_null_turns(spark):
    data = [(1, 2, "user", "b", "x"), (1, 2, "user", "a", "y"), (1, None, "system", "s", None), (1, 2, "user", "a", "y")]
    df = spark.createDataFrame(data, SCHEMA + ", segments string")
    (got,) = rows(chat.chat_digests(df))
    want = plain([("system", "s"), ("user", "a"), ("user", "a"), ("user", "b")])
    assert {k: got[k] for k in want} == want
    assert (got["valid"], got["wrong_turn"]) == (False, 2)


def test_empty_table(spark):
    assert rows(chat.chat_digests(spark.createDataFrame([], SCHEMA))) == []


def test_segments_and_the_text_that_they_make(spark):
    df = spark.createDataFrame([(7, 0, "system", "be <brief>"), (7, 1, "user", "hi [x]"), (7, 2, "assistant", "yes")], SCHEMA)
    (got,) = chat.formatted_conversations(df).withColumn("formatted", chat.formatted_text(F.col("segments"))).collect()
    assert got["formatted"] == "<<SYS>>\nbe \\{brief>\n<</SYS>>\n[INST] hi \\(x\\) [/INST]<s>yes</s>"
    assert [s["text"] for s in got["segments"] if s["loss"]] == ["yes"]


def test_another_template(spark):
    learn_all = chat.Template((chat.Turn("user", "<u>", "</u>", True), chat.Turn("assistant", "<a>", "</a>", True)), {"start": {"user": "u"}, "u": {"user": "u", "assistant": "a"}}, ("a", "u"))
    df = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "user", "y"), (1, 2, "assistant", "z"), (1, 3, "user", "w")], SCHEMA)
    (got,) = rows(chat.chat_digests(df, learn_all))
    assert (got["loss_sha256"], got["valid"], got["wrong_turn"], got["formatted_chars"]) == (sha("xyzw"), False, 3, 4 * 8)


def test_no_python_on_the_way(spark, small):
    plan = chat.chat_digests(table(spark, small, "conversations"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("text", MARKS)
def test_each_mark_is_escaped(spark, text):
    (row,) = spark.createDataFrame([(text,)], "t string").select(chat.escaped(F.col("t")).alias("e"), chat.unescaped(chat.escaped(F.col("t"))).alias("u")).collect()
    assert row["u"] == text and not set("[]<") & set(row["e"])
