import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.llm import token_counts as T
from spanwise.llm.common import table
from tests.llm.helpers import edge_docs, rows

RANKS = T.read_ranks(T.VOCABULARY)
COUNTER = T.Counter(RANKS)


def full(text):
    return len(COUNTER.encoding.encode_ordinary(text or ""))


def plain_edits(text, edits):
    text, limit = text or "", len(text or "")
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1], e[2] or ""), reverse=True):
        start = min(max(0, start), limit)
        text, limit = text[:start] + (new or "") + text[min(max(start, end), limit) :], start
    return text


PIECE = st.sampled_from(["a", "the ", " ", "  ", "\n", "\n\n", "'s", "'", "don't", "12", "3", "!!", "é", "汉字", "😀", "\t", "word" * 30, " x", " "])
TEXT = st.lists(PIECE, max_size=300).map("".join)


@settings(deadline=None, max_examples=300)
@given(TEXT, st.lists(st.tuples(st.integers(-5, 900), st.integers(-5, 900), st.none() | st.lists(PIECE, max_size=400).map("".join)), max_size=5), st.sampled_from([1, 2, 4, 64]))
def test_edits_against_full_counts(text, edits, leaf):
    before, T.LEAF = T.LEAF, leaf
    try:
        tree = T.Tree.of_text(text, COUNTER)
        assert (int(tree.chars[1]), int(tree.tokens[1])) == (len(text), full(text))
        got, again = T.apply_edits(text, tree, edits, COUNTER)
        assert got == plain_edits(text, edits) and again >= 0
        assert (int(tree.chars[1]), int(tree.tokens[1])) == (len(got), full(got))
        for v in range(1, tree.m):
            assert tree.tokens[v] == tree.tokens[2 * v] + tree.tokens[2 * v + 1] and tree.chars[v] == tree.chars[2 * v] + tree.chars[2 * v + 1]
    finally:
        T.LEAF = before


def test_a_small_edit_reads_little():
    text = "some words, and some more words. " * 3000
    tree = T.Tree.of_text(text, COUNTER)
    got, again = T.apply_edits(text, tree, [(50_000, 50_003, "THEM")], COUNTER)
    assert again < 1500 and tree.tokens[1] == full(got)


@pytest.mark.parametrize("kind", ["table", "edges", "empty"])
def test_query_rows(spark, small, kind):
    docs = {"table": table(spark, small, "documents"), "edges": edge_docs(spark), "empty": edge_docs(spark).limit(0)}[kind]
    wanted = {}
    for r in T.two_edits(docs).collect():
        text = plain_edits(r["text"], [(e["start"], e["end"], e["new"]) for e in r["edits"]])
        wanted[r["doc_id"]] = (full(r["text"]), full(text), len(text))
    got = rows(T.token_counts(docs))
    assert len(got) == docs.count()
    for r in got:
        assert (r["n_tokens"], r["n_tokens_edited"], r["edited_chars"]) == wanted[r["doc_id"]]


def test_edits_as_a_table(spark):
    docs = edge_docs(spark)
    trees = T.token_trees(docs)
    edits = spark.createDataFrame([(10, 0, 3, "Uno"), (10, 4, 4, "y "), (999, 0, 0, "x"), (1, 0, 5, "new"), (6, 3, 99, None), (None, 0, 1, "The")], "doc_id long, start int, end int, new string")
    got = {r["doc_id"]: r for r in rows(T.edited(trees, edits))}
    assert len(got) == docs.select("doc_id").distinct().count() and T.edited(trees, edits).count() == docs.count()
    assert got[10]["text"] == "Uno y Two THREE" and got[1]["text"] == "new" and got[6]["text"] == "one" and got[None]["text"] == "The text without an id"
    assert all(r["n_tokens"] == full(r["text"]) for r in got.values())
    again = T.edited(T.edited(trees, edits), spark.createDataFrame([(10, 0, 0, ">")], edits.schema))  # trees come back whole
    assert {r["n_tokens"] for r in rows(again.where(F.col("doc_id") == 10))} == {full(">Uno y Two THREE")}
