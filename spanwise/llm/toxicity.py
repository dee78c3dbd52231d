"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are binary: words, stems (first letters of longer words), bigrams and skip-grams over one or two
words, hashed to 2**``BITS`` slots. FTRL keeps a learning rate for each coordinate and an L1 penalty that leaves most
weights at exactly zero, so the model that tasks receive is the few non-zero slots: some thousands, never more than
the 2**``BITS`` slots (12 MB), whatever the corpus.

Training takes labelled rows whose share is set so that ``SAMPLE`` rows are expected, chosen by a hash of the id; that
is the only bound. They are dealt by hash to shards of about ``SHARD_ROWS`` rows, each runs FTRL for ``EPOCHS`` passes in a seeded
order, and the weights are averaged: a weight that a shard leaves at zero counts as zero, which thins out what only one
shard has memorised. Training takes the same memory and time for any corpus. Scoring is one pass without a shuffle.

Defined results: a null text counts as empty and is scored by the bias alone; labels other than 0 and 1 aren't learned
from; with no label to learn from, every score is 0; repeated rows give repeated results; a document with several
labels teaches each of them; an empty table of documents gives no rows; a very long text is scored whole, in memory in
proportion to its words; columns beside doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import bounded_batches, id_bucket, teaching_rows

BITS, STEM, SKIPS = 20, 4, (1, 2, 3)  # distances of the word pairs: bigrams, then skip-grams
SAMPLE, SHARD_ROWS, EPOCHS = 16_000, 4_000, 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 3.0, 0.0
THRESHOLD = 0.7
WORD = re.compile(r"\w+")
_SLOTS = np.uint32((1 << BITS) - 1)


class Words(dict):
    """Hash of a word in the lower 32 bits, of its stem (0 for short words) in the upper; remembered while there is room."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        stem = zlib.crc32(f"{word[:STEM]}*".encode("utf-8", "surrogatepass")) if len(word) > STEM else 0
        self[word] = value = zlib.crc32(word.encode("utf-8", "surrogatepass")) | stem << 32
        return value


_words = Words()  # a worker process keeps it over batches


def slots_of(text: str | None) -> np.ndarray:
    """Slots of a text's n-grams and skip-grams, repeats included."""
    words = WORD.findall((text or "").lower())
    both = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    hashes, stems = both.astype(np.uint32), (both >> np.uint64(32)).astype(np.uint32)
    stems = stems[stems != 0]
    found = [hashes ^ hashes >> np.uint32(15), stems ^ stems >> np.uint32(15)]
    for d in SKIPS:
        pairs = (hashes[:-d] * np.uint32(0x9E3779B1) ^ hashes[d:] + np.uint32(d)) * np.uint32(0x85EBCA77)
        found.append(pairs ^ pairs >> np.uint32(15))
    return (np.concatenate(found) & _SLOTS).astype(np.int32)


def features(text: str | None) -> np.ndarray:
    return np.unique(slots_of(text))


class Ftrl:
    """FTRL-proximal with per-coordinate rates for binary features; slot 2**BITS is the bias, which isn't penalised by L1."""

    def __init__(self, bits: int = BITS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2, self.bias = alpha, beta, l1, l2, 1 << bits
        self.z, self.n = np.zeros(self.bias + 1), np.zeros(self.bias + 1)

    def weights(self, slots: np.ndarray) -> np.ndarray:
        z, l1 = self.z[slots], np.where(slots == self.bias, 0.0, self.l1)
        rate = (self.beta + np.sqrt(self.n[slots])) / self.alpha + self.l2
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / rate)

    def learn(self, slots: np.ndarray, label: int) -> float:
        slots = np.append(slots, self.bias)
        w = self.weights(slots)
        p = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35)))
        g = p - label
        sigma = (np.sqrt(self.n[slots] + g * g) - np.sqrt(self.n[slots])) / self.alpha
        self.z[slots] += g - sigma * w
        self.n[slots] += g * g
        return p


def fit(texts: list[str | None], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(slots, weights) that aren't zero."""
    model = Ftrl()
    rows = [features(t) for t in texts]
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            model.learn(rows[i], labels[i])
    slots = np.nonzero(model.z)[0]
    w = model.weights(slots)
    return slots[w != 0], w[w != 0]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[int, float]:
    """Weights by slot from documents and their labels (doc_id, toxic)."""
    taught, n = teaching_rows(bounded_batches(docs), labels.where("toxic in (0, 1)").select("doc_id", F.col("toxic").alias("label")), sample, SHARD_ROWS)
    if not n:
        return {}
    shards = max(1, min(n, sample) // SHARD_ROWS)

    def shard_weights(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "label"])  # whatever order they came in
        slots, w = fit(rows["text"].tolist(), rows["label"].tolist())
        return pd.DataFrame({"slot": slots, "w": w})

    each = taught.groupBy("shard").applyInPandas(shard_weights, "slot long, w double")
    mean = each.groupBy("slot").agg((F.sum("w") / shards).alias("w"))
    return {r["slot"]: r["w"] for r in mean.collect()}  # at most 2**BITS + 1


def score(docs: DataFrame, weights: dict[int, float]):
    """A column with the probability of label 1 for each text of docs."""
    sent = docs.sparkSession.sparkContext.broadcast((np.array(list(weights), np.int64), np.array(list(weights.values()))))

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        slots, weights = sent.value
        if not len(slots):
            return pd.Series(np.zeros(len(texts)))
        table, used = np.zeros((1 << BITS) + 1, np.float32), np.zeros(1 << BITS, bool)
        table[slots], used[slots[slots < 1 << BITS]] = weights, True
        margin = np.empty(len(texts))
        for i, t in enumerate(texts):
            found = slots_of(t)
            margin[i] = table[np.unique(found[used[found]])].sum(dtype=np.float64)  # other slots weigh nothing
        margin += table[1 << BITS]
        return pd.Series(1 / (1 + np.exp(-np.clip(margin, -35, 35))))

    return scored(F.col("text"))


def toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted (1 from ``THRESHOLD`` up); learned only from documents that aren't held out."""
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    weights = learn(docs.where(~held_out), labels.where(~held_out), sample)
    scored = bounded_batches(docs).select("doc_id", held_out.alias("held_out"), score(docs, weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
