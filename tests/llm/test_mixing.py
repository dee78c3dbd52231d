import itertools
import random
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.llm import mixing as M
from spanwise.llm.common import table
from tests.llm.helpers import edge_docs, rows


def plain_targets(sizes):
    """The contract's targets, step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    stopped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in stopped)
        free = sum(weight[s] for s in order if s not in stopped)
        target = {s: 2.0 * sizes[s] if s in stopped else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in stopped and target[s] > 2 * sizes[s]}
        if not over:
            return target
        stopped |= over


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 20, "c": 30, "B": 5, "é": 7, None: 9}, {"a": 0}, {"a": 0, "b": 7, None: 0}, {"x": 1000, "y": 1, "z": 1, "w": 1, "v": 900}, {f"s{i:02d}": (i * 37) % 101 for i in range(60)},
])
def test_targets(spark, sizes):
    want = plain_targets(sizes)
    sources = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in rows(M.with_targets(sources, sum(sizes.values())))}
    assert all(abs(got[s] - want[s]) < 1e-6 for s in sizes) and abs(sum(got.values()) - 1.5 * sum(sizes.values())) < 1e-6


def check(docs):
    got = rows(M.mix_by_source(docs))
    assert len(got) == docs.count()
    sizes, by_row = {}, []
    for r in docs.select("doc_id", "text", "source").collect():
        n = len((r["text"] or "").encode().split())
        sizes[r["source"]] = sizes.get(r["source"], 0) + n
        by_row.append((r["doc_id"], n, r["source"]))
    want = plain_targets(sizes) if sizes else {}
    assert sorted(((d, n, sizes[s], round(want[s], 6)) for d, n, s in by_row), key=str) == sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6)) for r in got), key=str)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    taken = {}
    source_of = {(d, n): s for d, n, s in by_row}
    for r in got:
        s = source_of[r["doc_id"], r["size"]]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    assert sorted(map(str, got)) == sorted(map(str, rows(M.mix_by_source(docs.repartition(3)))))


def test_query_rows(spark, small):
    check(table(spark, small, "documents"))
    check(edge_docs(spark))
    check(edge_docs(spark).limit(0))


def test_positions_in_many_buckets(spark, small, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 3)
    check(table(spark, small, "documents"))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.integers(0, 4), min_size=3, max_size=3), st.lists(st.integers(0, 9), min_size=2, max_size=2))
def test_flow_is_the_cheapest_of_all(sizes, wants):
    patterns = {("a",): sizes[0], ("b",): sizes[1], ("a", "b"): sizes[2]}
    gives = M.route(patterns, {"a": wants[0], "b": wants[1]}, {p: list(p) for p in patterns})
    flow = {(p, s): f for p, x in gives.items() for s, f in x.items()}
    cost = lambda used: sum(max(0, n - patterns[p]) for p, n in used.items())
    best = max(
        (min(a + x, wants[0]) + min(b + y, wants[1]), -cost({("a",): a, ("b",): b, ("a", "b"): x + y}))
        for a, b in itertools.product(range(2 * sizes[0] + 1), range(2 * sizes[1] + 1))
        for x in range(2 * sizes[2] + 1)
        for y in range(2 * sizes[2] - x + 1)
        if a + x <= wants[0] and b + y <= wants[1]
    )
    used = {p: sum(f for (q, _), f in flow.items() if q == p) for p in patterns}
    assert all(n <= 2 * patterns[p] for p, n in used.items())
    assert (sum(flow.values()), -cost(used)) == best


def test_overlapping_sources(spark):
    docs = spark.createDataFrame([(i, ["a"] if i < 10 else ["b", "a"] if i < 20 else ["b"], 100) for i in range(30)], "doc_id long, members array<string>, n long")
    got = rows(M.mix(docs, F.col("members"), F.col("n").cast("long")))
    assert {tuple(r["members"]) for r in got} == {("a",), ("a", "b"), ("b",)}
    assert sum(r["taken"] for r in got) == 4500 and max(r["taken"] for r in got) <= 200


def test_five_thousand_sources(spark):
    """Each document has a source of its own: many small components, and nothing on the driver."""
    docs = spark.createDataFrame([(i, "word " * (i % 7 + 1), f"host{i:05d}.example") for i in range(5000)], "doc_id long, text string, source string")
    check(docs)


def test_the_query_goes_through_the_flow(spark, small, monkeypatch):
    """Without the flow nothing is taken; with it each pattern's amount is its quota, as far as two copies go."""
    docs = table(spark, small, "documents")
    got = rows(M.mix_by_source(docs))
    wants = {(r["source_size"], r["target"]) for r in got}
    taken = {w: sum(r["taken"] for r in got if (r["source_size"], r["target"]) == w) for w in wants}
    assert all(n == min(round(target), 2 * size) for (size, target), n in taken.items())
    monkeypatch.setattr(M, "_amounts", lambda links, most: links.select("pattern", F.lit(0).cast("long").alias("amount")).distinct())
    assert sum(r["taken"] for r in rows(M.mix_by_source(docs))) == 0


def test_batches_of_components(spark, monkeypatch):
    """Any number of batches gives the same amounts."""
    data = [(i, [f"s{i % 40}"] if i % 3 else [f"s{i % 40}", f"s{(i + 1) % 40 // 2 * 2}"], i % 17) for i in range(300)]
    docs = spark.createDataFrame(data, "doc_id long, members array<string>, n long")
    took = []
    for links in (5000, 7):
        monkeypatch.setattr(M, "BATCH_LINKS", links)
        took.append(sum(r["taken"] for r in rows(M.mix(docs, F.col("members"), F.col("n")))))
    assert took[0] == took[1] > 0


def test_ten_thousand_overlapping_patterns():
    """One component of 10,000 patterns over 200 sources: full quotas, and repeats only where a quota needs them."""
    rng = random.Random(3)
    members = {i: sorted(rng.sample(range(200), rng.randint(1, 3))) for i in range(10_000)}
    patterns = {i: rng.randint(1, 500) for i in members}
    targets = {s: 9000.0 for s in range(200)}
    began = time.process_time()
    gives = M.route(patterns, targets, members)
    assert time.process_time() - began < 20
    got = {s: sum(g.get(s, 0) for g in gives.values()) for s in targets}
    assert got == targets  # 2.5 million words for 1.8 million
    assert sum(max(0, sum(g.values()) - patterns[p]) for p, g in gives.items()) == 0
    assert all(set(g) <= set(members[p]) for p, g in gives.items())


def test_components_of_overlapping_sources(spark):
    """Chains of sources that overlap, beside sources that don't, against one network over all of them."""
    rng = random.Random(5)
    data = [(i, rng.choice([["a", "b"], ["b", "c"], ["a"], ["d", "e"], ["e"], ["f"], [None], [None, "f"], ["g"], []]), rng.randint(0, 40)) for i in range(400)]
    docs = spark.createDataFrame(data, "doc_id long, members array<string>, n long")
    got = rows(M.mix(docs, F.col("members"), F.col("n")))
    assert len(got) == 400 and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    sizes, sources = {}, {}
    key = lambda m: tuple(sorted({x or "~null" for x in m}))
    for _, m, n in data:
        sizes[key(m)] = sizes.get(key(m), 0) + n
    for m, n in sizes.items():
        for x in m:
            sources[x] = sources.get(x, 0) + n
    targets = {s: next(r["targets"][sorted(r["members"], key=lambda x: (x is None, x)).index(None if s == "~null" else s)] for r in got if (None if s == "~null" else s) in r["members"]) for s in sources}
    best = M.route(sizes, targets, {p: list(p) for p in sizes})
    assert sum(r["taken"] for r in got) == sum(sum(g.values()) for g in best.values())
    taken = {}
    for r in got:
        taken[key(r["members"])] = taken.get(key(r["members"]), 0) + r["taken"]
    repeats = lambda used: sum(max(0, n - sizes[p]) for p, n in used.items())
    assert repeats(taken) == repeats({p: sum(g.values()) for p, g in best.items()})
    assert all(r["taken"] == 0 and r["targets"] == [] for r in got if not r["members"])
