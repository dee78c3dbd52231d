"""The audit of filters against filters applied one after the other, in every order."""

import itertools
import re

from spanwise.llm import filter_audit
from tests.llm.helpers import SCHEMA, edge_docs, rows

LABELS = "doc_id long, quality int, toxic int"


def failed(docs):
    """The filters that each document fails, told literally."""
    least = {}
    for d in docs:
        text = d["text"] or ""
        if d["doc_id"] is not None:
            least[text] = min(least.get(text, d["doc_id"]), d["doc_id"])
    out = []
    for d in docs:
        text = d["text"] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = set()
        if len(words) < 200:
            fails.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            fails.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 2 * len(text):
            fails.add("C")
        if re.search(r"[#$%&*|]", text):
            fails.add("D")
        if d["doc_id"] is not None and least[text] < d["doc_id"]:
            fails.add("E")
        out.append(fails)
    return out


def brute(docs, labels):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    fails = failed(docs)
    for part in {d["source"] or "" for d in docs}:
        own = [(d, f) for d, f in zip(docs, fails, strict=True) if (d["source"] or "") == part]
        removed_by = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for i, name in enumerate(order):
                gone, stay = [x for x in left if name in x[1]], [x for x in left if name not in x[1]]
                removed_by[name] += len(gone)
                n_failing = sum(name in f for _, f in own)
                out[part, "".join(order), i + 1] = {
                    "kept": len(stay), "removed": len(gone), "redundant": n_failing - len(gone), "unique_fails": sum(f == {name} for _, f in own),
                    "good_lost": sum(d["doc_id"] in good for d, _ in gone), "toxic_lost": sum(d["doc_id"] in toxic for d, _ in gone),
                }
                left = stay
        for (p, order, step), row in out.items():
            if p == part:
                row["shapley"] = removed_by[order[step - 1]]
    return out


def check(spark, df, labels):
    got = {(r.pop("part"), r.pop("filter_order"), r.pop("step")): r for r in rows(filter_audit.filter_audit(df, spark.createDataFrame(labels, LABELS)))}
    assert got == brute(rows(df), labels)


def test_edge_rows(spark):
    check(spark, edge_docs(spark), [(1, 1, 1), (4, 1, 0), (4, 0, 1), (None, 1, 1), (9, None, 1), (11, 1, None), (99, 1, 1)])


def test_copies_over_parts(spark):
    base = {"long": " ".join(f"w{i}" for i in range(250)), "dull": "word " * 300, "loud": "LOUD WORDS " * 150, "odd": "some # text", "both": "A|B " * 120}
    texts = list(base.values())
    data = [(i if i % 17 else None, texts[(i * 7) % 5] + ("" if i % 3 else f" v{i % 4}"), "en", (None, "", "a", "b")[i % 4], 1, "k", "f", 0.0, ["w"], 0) for i in range(160)]
    check(spark, spark.createDataFrame(data + data[:20], SCHEMA), [(i, i % 2, (i // 2) % 2) for i in range(0, 160, 3)])


def test_empty_tables(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert rows(filter_audit.filter_audit(nothing, spark.createDataFrame([], LABELS))) == []
    some = spark.createDataFrame([(1, "x", "en", "s", 1, "k", "f", 0.0, ["w"], 0)], SCHEMA)
    check(spark, some, [])


def test_a_text_that_most_rows_share_is_counted_before_it_meets(spark):
    """However many copies a text has, a row for each part and labels is left of it when texts meet."""
    data = [(i, "the same text", "en", f"s{i % 3}", 1, "k", "f", 0.0, ["w"], 0) for i in range(3000)]
    df = spark.createDataFrame(data, SCHEMA)
    cells = {(r["part"], r["mask"]): r["n"] for r in rows(filter_audit.mask_cells(df, spark.createDataFrame([], LABELS))) if r["n"]}
    a, e = filter_audit.BIT["A"], filter_audit.COPY
    assert cells == {("s0", a): 1, ("s0", a + e): 999, ("s1", a + e): 1000, ("s2", a + e): 1000}


def test_the_orders():
    assert len(filter_audit.orders()) == 600 and len({o for o, *_ in filter_audit.orders()}) == 120
