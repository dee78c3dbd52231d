import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from spanwise.llm import quality as Q
from spanwise.llm.common import table
from tests.llm.helpers import edge_docs, rows


def test_ordinal_fit_finds_the_order():
    rng = np.random.default_rng(0)
    texts, grades = [], []
    for _ in range(1200):
        level = rng.uniform(0, 3)
        words = rng.choice(["fine", "poor"], 120, p=[level / 3, 1 - level / 3])
        texts.append(" ".join(words))
        grades.append(int(np.clip(np.round(level + rng.normal(0, 0.2)), 0, 3)))
    grades = np.array(grades)
    w, cuts = Q.fit([Q.features(t) for t in texts[:900]], grades[:900], 4)
    assert (np.diff(cuts) > 0).all() and len(cuts) == 3
    score = np.array([v @ w[s] for s, v in map(Q.features, texts[900:])])
    expected = Q._sigmoid(score[:, None] - cuts[None, :]).sum(axis=1)
    assert np.abs(expected - grades[900:]).mean() < 0.45
    assert np.corrcoef(expected, grades[900:])[0, 1] > 0.9


def test_gradient_improves_the_likelihood():
    rows_ = [Q.features(t) for t in ("a a b", "B!! C!!", "x y z", "x x x")]
    grades = np.array([2, 0, 1, 0])
    like = []
    for steps in (1, 20, 80):
        w, cuts = Q.fit(rows_, grades, 3, steps)
        score = np.array([v @ w[s] for s, v in rows_])
        tail = np.hstack([np.ones((4, 1)), Q._sigmoid(score[:, None] - cuts[None, :]), np.zeros((4, 1))])
        like.append(np.log(np.maximum(1e-12, tail[range(4), grades] - tail[range(4), grades + 1])).sum())
    assert like[0] < like[1] < like[2]


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = Q.quality(docs, labels)
    held = got.where("held_out").join(labels, "doc_id")
    assert held.agg(F.avg((F.col("keep") == (F.col("quality") == 1)).cast("int"))).first()[0] > 0.98
    order = [r[1] for r in sorted(held.groupBy((F.col("quality") * (2 - F.col("toxic"))).alias("grade")).agg(F.avg("expected_grade")).collect())]
    assert order == sorted(order)
    assert got.where("tail_best > tail_good + 1e-12 or abs(expected_grade - tail_good - tail_best) > 1e-9").count() == 0
    assert got.count() == docs.count()


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 0, 1), (6, 0, None), (7, None, 0), (None, 1, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    for teach in (labels, labels.limit(0), labels.where("quality = 0")):
        got = rows(Q.quality(docs, teach))
        assert len(got) == docs.count() and all(0 <= r["tail_best"] <= r["tail_good"] <= 1 for r in got)
    assert rows(Q.quality(docs.limit(0), labels)) == []


def plain_fit(rows_, grades, k, steps):
    """Weights by slot and thresholds: the likelihood of one row at a time, its slope by differences, Adam by coordinate."""
    slots = sorted({int(s) for found, _ in rows_ for s in found})
    share = [max(1e-3, sum(g >= j for g in grades) / len(grades)) for j in range(1, k)]
    params = {("w", s): 0.0 for s in slots} | {("cut", 0): -math.log(share[0] / (1 - min(share[0], 0.999)))} | {("cut", j): 0.0 for j in range(1, k - 1)}
    m, v = dict.fromkeys(params, 0.0), dict.fromkeys(params, 0.0)

    def cuts(p):
        out = [p["cut", 0]]
        for j in range(1, k - 1):
            out.append(out[-1] + math.exp(p["cut", j]))
        return out

    def likelihood(p):
        total, at = 0.0, cuts(p)
        for (found, values), g in zip(rows_, grades, strict=True):
            score = sum(p["w", int(s)] * float(x) for s, x in zip(found, values, strict=True))
            tail = [1.0, *(1 / (1 + math.exp(-(score - t))) for t in at), 0.0]
            total += math.log(tail[g] - tail[g + 1])
        return total / len(grades)

    for step in range(1, steps + 1):
        slope = {}
        for key in params:
            up, down = params | {key: params[key] + 1e-5}, params | {key: params[key] - 1e-5}
            slope[key] = (likelihood(up) - likelihood(down)) / 2e-5 - (Q.RIDGE * params[key] if key[0] == "w" else 0)
        for key, g in slope.items():
            m[key] += 0.1 * (g - m[key])
            v[key] += 0.01 * (g * g - v[key])
            params[key] += Q.RATE * (m[key] / (1 - 0.9**step)) / (math.sqrt(v[key] / (1 - 0.99**step)) + 1e-8)
    return {s: params["w", s] for s in slots}, cuts(params)


TAUGHT = [("good words here. They go on well", 2), ("good. words here", 2), ("good rude words rude", 1), ("rude rude here. good", 1), ("@@@ ### xx xx xx", 0), ("xx ### xx", 0), ("words xx ###", 0)]


def test_fit_against_one_row_at_a_time():
    rows_, grades = [Q.features(t) for t, _ in TAUGHT], [g for _, g in TAUGHT]
    for k in (3, 4):  # with a grade that nothing has
        w, cuts = Q.fit(rows_, np.array(grades), k, 12)
        want, at = plain_fit(rows_, grades, k, 12)
        assert np.allclose(cuts, at, atol=2e-3) and all(abs(w[s] - x) < 2e-3 for s, x in want.items())
        assert np.count_nonzero(w) == len(want)


def test_query_against_brute_force(spark):
    """The whole query on a small table: the plain fit, and the plain score of every text."""
    ids = [i for i in range(1, 60) if zlib.crc32(str(i).encode()) % 3 != 1][: len(TAUGHT)]
    others = [(1000, "good words"), (1001, None), (1002, "xx rude ###")]
    docs = spark.createDataFrame([*((i, t) for i, (t, _) in zip(ids, TAUGHT, strict=True)), *others], "doc_id long, text string")
    grade = {0: (0, 1), 1: (1, 1), 2: (1, 0)}
    labels = spark.createDataFrame([(i, *grade[g]) for i, (_, g) in zip(ids, TAUGHT, strict=True)], "doc_id long, quality int, toxic int")
    ordered = sorted(TAUGHT)
    w, cuts = plain_fit([Q.features(t) for t, _ in ordered], [g for _, g in ordered], 3, Q.STEPS)
    for r, text in ((r, dict([*zip(ids, (t for t, _ in TAUGHT), strict=True), *others])[r["doc_id"]]) for r in rows(Q.quality(docs, labels))):
        score = sum(w.get(int(s), 0.0) * float(x) for s, x in zip(*Q.features(text), strict=True))
        tail = [1 / (1 + math.exp(-(score - t))) for t in cuts]
        assert abs(r["tail_good"] - tail[0]) < 0.01 and abs(r["tail_best"] - tail[1]) < 0.01 and abs(r["expected_grade"] - sum(tail)) < 0.02
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["keep"] == (r["tail_good"] >= 0.5)
