import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from spanwise.llm import decontam
from spanwise.llm.common import table
from tests.llm.helpers import edge_docs, rows

WORD = regex.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plain(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(13, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if (at := windows.get(tuple(w[i : i + n]))) is not None:
                    hit.update(range(i, i + n))
                    found |= at
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def check(docs, items):
    pairs = lambda df, key: [(r[key], r["text"]) for r in df.select(key, "text").collect()]
    want = plain(pairs(docs, "doc_id"), pairs(items, "item_id"))
    got = [tuple(r.values()) for r in rows(decontam.decontaminate(docs, items))]
    assert sorted(got, key=str) == want
    kept = sorted(str(r["doc_id"]) for r in rows(decontam.drop_contaminated(docs, items)))
    assert kept == sorted(str(r[0]) for r in want if not r[-1])
    return want


def test_against_brute_force(spark, small, monkeypatch):
    docs, items = table(spark, small, "documents"), table(spark, small, "benchmark")
    assert any(r[-1] for r in check(docs, items))
    for bound in ("BROADCAST_RUNS", "BROADCAST_BYTES"):  # the way that shuffles
        with monkeypatch.context() as m:
            m.setattr(decontam, bound, 0)
            check(docs, items)


def test_edges_and_short_items(spark, monkeypatch):
    long = " ".join(f"w{i}" for i in range(40))
    texts = [long, "x " + long.upper(), " ".join(f"w{i}" for i in range(12)), "y w0 w1, w2 w3 " + long[:60], "same " * 40, "same " * 13, "same " * 12, "word", "the Word."]
    items = spark.createDataFrame([(1, long), (2, " ".join(f"w{i}" for i in range(5, 25))), (3, "same " * 20), (4, "word"), (5, None), (6, ""), (7, "--"), (8, "w0 w1"), (8, "w1 w2"), (9, "one two three")], "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    check(docs, items)
    with monkeypatch.context() as m:
        m.setattr(decontam, "BROADCAST_RUNS", 0)
        check(docs, items)
    check(edge_docs(spark), items)
    check(edge_docs(spark).limit(0), items)
    check(docs, items.limit(0))


def test_null_item_id_counts_hits_only(spark):
    docs = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "one two three")], "item_id long, text string")
    assert rows(decontam.decontaminate(docs, items))[0]["n_hit"] == 3


def test_no_python_on_the_main_path(spark, small):
    plan = decontam.decontaminate(table(spark, small, "documents"), table(spark, small, "benchmark"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_few_but_huge_runs_are_not_broadcast(spark):
    """A word has no length limit: 40 runs of 13 words of 200,000 characters each are over the bound in bytes."""
    words_ = [f"w{i}" + "x" * 200_000 for i in range(52)]
    items = spark.createDataFrame([(1, " ".join(words_))], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join(words_[20:40])), (2, "nothing of it")], "doc_id long, text string")
    df = decontam.decontaminate(docs, items)
    assert {r["doc_id"]: (r["n_hit"], r["n_items"]) for r in rows(df)} == {1: (20, 1), 2: (0, 0)}
    assert "SortMergeJoin" in df._jdf.queryExecution().sparkPlan().toString()


def test_short_items_take_one_pass(spark, small):
    docs = table(spark, small, "documents")
    items = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in range(1, 13)], "item_id long, text string")
    plan = decontam.contamination(docs, items)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode(") == 1


def test_positions_that_do_not_fit_fail(spark, monkeypatch):
    monkeypatch.setattr(decontam, "POSITION_BITS", 6)
    words = lambda n: spark.createDataFrame([(" ".join(f"w{i}" for i in range(n)),)], "text string").select(decontam.selected(decontam.words_of(F.col("text"))).alias("s"))
    assert words(64).first()["s"]
    with pytest.raises(Exception, match="more than 2"):
        words(65).collect()
