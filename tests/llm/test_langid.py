import itertools
import random
import tracemalloc

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanwise.llm import langid as L
from spanwise.llm.common import id_bucket, table
from tests.llm.helpers import edge_docs, rows


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    got = L.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = got.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("lang")).first()
    assert n > 100 and right / n > 0.98


def small_model(k, seed):
    rng = np.random.default_rng(seed)
    words = {w: rng.normal(0, 4, k).astype(np.float32) for w in "abcdefgh"}
    return L.Model([f"l{i}" for i in range(k)], {"Latin": list(range(k))}, words, np.zeros((1 << L.TRIGRAM_BITS, k), np.float32))


@settings(deadline=None, max_examples=40)
@given(st.integers(2, 3), st.integers(0, 99), st.lists(st.lists(st.sampled_from("abcdefgh"), min_size=1, max_size=6), min_size=1, max_size=5))
def test_path_is_the_best_of_all(k, seed, documents):
    model = small_model(k, seed)
    for words, (_, path) in zip(documents, model.spans([" ".join(d) for d in documents]), strict=True):
        scores = model.of_words(words).astype(float)
        value = lambda p: sum(s[i] for s, i in zip(scores, p, strict=True)) - L.SWITCH * sum(a != b for a, b in itertools.pairwise(p))
        assert value(path) >= max(map(value, itertools.product(range(k), repeat=len(words)))) - 1e-3


@pytest.mark.parametrize("block", [1, 7, 40])
def test_pieces_give_the_same_paths(monkeypatch, block):
    rng = random.Random(block)
    texts = [" ".join(w for _ in range(rng.randint(0, 4)) for w in [rng.choice(["abc", "bad", "c", "dada", "e", "fghe", "h"])] * rng.randint(1, 15)) for _ in range(60)]
    lengths = set()
    for seed in range(4):
        model = small_model(3, seed)
        model.trigrams = np.random.default_rng(seed).normal(0, 1.5, model.trigrams.shape).astype(np.float32)
        want = model.spans(texts)
        with monkeypatch.context() as m:
            m.setattr(L, "BLOCK", block)
            got = model.spans(texts)
        assert [(w, p.tolist()) for w, p in got] == [(w, p.tolist()) for w, p in want]
        lengths |= {len(set(p.tolist())) for _, p in got}
    assert len(lengths) > 2  # none, one and several languages


def test_memory_of_a_long_text_under_many_languages():
    k, rng = 300, random.Random(2)
    names = sorted({"".join(rng.choice("abcdefghijklmnop") for _ in range(5)) for _ in range(20_000)})
    model = L.Model([f"l{i:03d}" for i in range(k)], {"Latin": list(range(k))}, {}, np.random.default_rng(1).normal(0, 1, (1 << L.TRIGRAM_BITS, k)).astype(np.float32))
    text = " ".join(rng.choice(names) for _ in range(30_000))
    tracemalloc.start()
    path = model.spans([text])[0][1]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(path) == 30_000 and peak < 80e6


def test_path_that_never_visits_the_best_total():
    words = {"a": np.array([0, -6, -2.9], np.float32), "b": np.array([-6, 0, -2.9], np.float32)}
    model = L.Model(["x", "y", "z"], {"Latin": [0, 1, 2]}, words, np.zeros((1 << L.TRIGRAM_BITS, 3), np.float32))
    assert model.spans(["a a a b b b"])[0][1].tolist() == [0, 0, 0, 1, 1, 1]
    assert model.spans(["a a b b"])[0][1].tolist() == [2, 2, 2, 2]  # gains of 5.8 twice are less than a change


def test_mixed_text_gives_spans(spark):
    rows_ = [(i, " ".join(["the and with from house water"] * 8), "en") for i in range(40)] + [(100 + i, " ".join(["der und mit von haus wasser"] * 8), "de") for i in range(40)]
    rows_ += [(200 + i, " ".join(["дом вода и с из"] * 8), "ru") for i in range(40)]
    model = L.learn(spark.createDataFrame(rows_, "doc_id long, text string, lang string"))
    text = "the house and the water with the house from the water " * 2 + "der wasser und das haus mit dem haus von der wasser"
    words, path = model.spans([text])[0]
    labels = [model.languages[i] for i in path]
    assert labels == ["en"] * 22 + ["de"] * 11 and len(words) == 33
    assert model.predict(["нечто совсем новое"])[0][0] == "ru"  # by script alone
    assert model.predict([None, "", "123 -- ½²", "the"]) == [("und", 0.0)] * 3 + [("en", 1.0)]


def test_text_in_three_languages_is_kept(spark):
    said = {"en": "the and with from house water", "de": "der und mit von haus wasser", "ru": "дом вода и с из"}
    rows_ = [(100 * n + i, " ".join([words] * 8), lang) for n, (lang, words) in enumerate(said.items()) for i in range(40)]
    rows_ += [(1000, " ".join(" ".join([words] * 4) for words in said.values()), None), (1001, "123 --", None)]
    docs = spark.createDataFrame(rows_, "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["score"] for r in rows(L.identify(docs))}[1000] < 0.5
    kept = {r["doc_id"] for r in rows(L.keep_identified(docs))}
    assert 1000 in kept and 1001 not in kept


def test_edges(spark):
    docs = edge_docs(spark)
    got = rows(L.identify(docs))
    assert len(got) == docs.count() and all(0 <= r["score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 8)} == {"und"}
    assert all(r["held_out"] == (b == 2) for r, b in zip(sorted(got, key=str), [x["b"] for x in sorted(rows(docs.select("doc_id", id_bucket(F.col("doc_id"), 4).alias("b"))), key=lambda x: str(next(g for g in got if g["doc_id"] == x["doc_id"])))], strict=True))
    assert rows(L.identify(docs.limit(0))) == []
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in rows(L.identify(unlabelled))} == {"und"}
    assert L.keep_identified(docs).columns == docs.columns
    assert not {1, 2, 3, 8} & {r["doc_id"] for r in rows(L.keep_identified(docs))}


def test_trigrams_follow_the_words():
    words = ["a", "abc", "été", "汉字", "abc"]
    slots, n, script = L.trigram_slots(words)
    assert n.tolist() == [1, 3, 3, 2, 3] and [L.SCRIPTS[i][1] for i in script] == ["Latin", "Latin", "Latin", "Han", "Latin"]
    each = [L.trigram_slots([w])[0].tolist() for w in words]
    assert slots.tolist() == sum(each, []) and each[1] == each[4]
    assert len(set(each[1])) == 3 and max(slots) < 1 << L.TRIGRAM_BITS


def test_three_hundred_languages():
    k = 300
    words = {f"w{i}x".translate(str.maketrans("0123456789", "abcdefghij")): np.where(np.arange(k) == i, 0, -9).astype(np.float32) for i in range(k)}
    names = list(words)
    model = L.Model([f"l{i:03d}" for i in range(k)], {"Latin": list(range(k))}, words, np.zeros((1 << L.TRIGRAM_BITS, k), np.float32))
    text = " ".join([names[299]] * 4 + [names[140]] * 5 + [names[0]] * 9)
    assert model.spans([text, names[200]])[0][1].tolist() == [299] * 4 + [140] * 5 + [0] * 9
    assert [p[0] for p in model.predict([text, names[200], " ".join([names[131]] * 3)])] == ["l000", "l200", "l131"]


def test_more_languages_than_a_byte_counts(spark):
    letters = "abcdefghijklmn"
    taught = [(10 * i + j, " ".join([f"{a}{b}{a}xx", f"yy{b}{a}{b}"] * 4), f"{a}{b}") for i, (a, b) in enumerate(itertools.product(letters, letters[:10])) for j in range(2)]
    docs = spark.createDataFrame(taught, "doc_id long, text string, lang string")
    model = L.learn(docs)
    assert len(model.languages) == 140
    said = model.predict([t for _, t, _ in taught])
    assert sum(p == lang for (p, _), (_, _, lang) in zip(said, taught, strict=True)) >= 0.97 * len(taught)


def test_clashing_names_and_very_long_texts(spark):
    docs = spark.createDataFrame([(1, "the house and water " * 3, "en", "a", 1.0), (2, "the water and house " * 150_000, "en", "b", 2.0), (3, "haus und wasser " * 3, "de", "c", 3.0)], "doc_id long, text string, lang string, __said string, Score double")
    kept = L.keep_identified(docs)
    assert kept.columns == docs.columns and sorted(r["__said"] for r in rows(kept)) == ["a", "b", "c"]
