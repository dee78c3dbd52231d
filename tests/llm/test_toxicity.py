import numpy as np
from pyspark.sql import functions as F

from spanwise.llm import toxicity as T
from spanwise.llm.common import table
from tests.llm.helpers import edge_docs, rows


def test_ftrl_against_the_plain_recursion():
    """Per coordinate, one at a time, as in the published algorithm."""
    rng = np.random.default_rng(0)
    model, z, n = T.Ftrl(bits=4, alpha=0.5, beta=1.0, l1=0.3, l2=0.1), {}, {}

    def weight(i):
        l1 = 0.0 if i == 16 else 0.3
        x = z.get(i, 0.0)
        return 0.0 if abs(x) <= l1 else -(x - np.sign(x) * l1) / ((1.0 + np.sqrt(n.get(i, 0.0))) / 0.5 + 0.1)

    for _ in range(200):
        slots, label = np.unique(rng.integers(0, 16, 4)), int(rng.integers(0, 2))
        every = [*slots.tolist(), 16]
        p = 1 / (1 + np.exp(-sum(map(weight, every))))
        assert abs(model.learn(slots, label) - p) < 1e-9
        old = {i: weight(i) for i in every}
        for i in every:
            g = p - label
            sigma = (np.sqrt(n.get(i, 0.0) + g * g) - np.sqrt(n.get(i, 0.0))) / 0.5
            z[i] = z.get(i, 0.0) + g - sigma * old[i]
            n[i] = n.get(i, 0.0) + g * g


def test_features_are_ngrams_and_skipgrams():
    one, two = (set(T.features(t).tolist()) for t in ("alpha beta gamma delta", "Alpha, BETA; gamma -- delta"))
    assert one == two and len(one) == 4 + 3 + 3 + 2 + 1  # words, stems of the longer ones, pairs at three distances
    assert len(T.features("beta alpha")) == len(T.features("alpha beta")) and set(T.features("beta alpha")) != set(T.features("alpha beta"))
    assert len(T.features(None)) == len(T.features("...")) == 0


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = T.toxicity(docs, labels)
    held = got.where("held_out").join(labels, "doc_id")
    missed = held.where("toxic = 1").agg(1 - F.avg("predicted")).first()[0]
    false = held.where("toxic = 0").agg(F.avg("predicted")).first()[0]
    assert false < 0.005 and missed < 0.2  # 305 toxic ones among 2,600 labels; the check tables have ten and fifty times as many
    assert got.count() == docs.count()


def test_edges(spark):
    docs = edge_docs(spark)
    labels = spark.createDataFrame([(4, 1, 1), (5, 1, 0), (5, 0, 1), (6, 1, None), (7, 1, 2), (None, 1, 1), (12, 1, 0)], "doc_id long, quality int, toxic int")
    for teach in (labels, labels.limit(0), labels.where("toxic = 0")):
        got = rows(T.toxicity(docs, teach))
        assert len(got) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in got)
    assert {r["score"] for r in rows(T.toxicity(docs, labels.limit(0)))} == {0.0}
    assert rows(T.toxicity(docs.limit(0), labels)) == []
    first, second = (sorted(map(str, rows(T.toxicity(d, labels)))) for d in (docs, docs.repartition(5)))
    assert first == second


def test_every_weight_is_kept(spark):
    """More slots than any cut would leave: the model is the plain fit of the one shard."""
    texts = [(i, " ".join(f"w{(i * 37 + j) % 4001}" for j in range(300)), None) for i in range(120)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, toxic int")
    taught = sorted((t, i % 2) for i, t, _ in texts)
    slots, w = T.fit([t for t, _ in taught], [x for _, x in taught])
    got = T.learn(docs, labels)
    assert set(got) == set(slots.tolist()) and all(abs(got[s] - x) < 1e-12 for s, x in zip(slots.tolist(), w, strict=True))
