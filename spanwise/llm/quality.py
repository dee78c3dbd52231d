"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text.

One weight vector over hashed features is shared by all grades; ordered thresholds t1 < t2 < ... cut the line into
grades: P(grade >= j) = sigmoid(w.x - tj). So a text gets an expected grade and tail probabilities that can't contradict
each other. Features are hashed words (lower-cased), each word's shape (case, digits, punctuation, length) and the
shapes' bigrams, and whether a word repeats the one before it; counts go in as their square roots over the root of the
length, so long and short texts compare.

Fitting is full-batch gradient descent with Adam steps, in Spark: the bounded sample of labelled rows (``SAMPLE``
expected, chosen by a hash of the id) is turned into sparse rows once and dealt to ``SHARD_ROWS``-row shards; each
shard fits, and the shards' weights and thresholds are averaged. Scoring is one pass without a shuffle.

The query's ratings have three grades: 0 for low quality, 1 for good but toxic, 2 for good and clean.

Defined results: a null text counts as empty and is scored by the thresholds alone; a rating that is null isn't learned
from; with fewer than two grades every document gets the only grade there is (0 without any) and tail probability 0 or
1; repeated rows give repeated results; an empty table of documents gives no rows; a very long text is read whole, at some
20 bytes a word; a tail probability of exactly 0.5 keeps; a grade that no row has lies between its neighbours' thresholds;
columns beside doc_id, text and the ratings are ignored, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.llm.common import bounded_batches, id_bucket, teaching_rows

BITS, SAMPLE, SHARD_ROWS, STEPS, RATE, RIDGE = 16, 16_000, 4_000, 120, 0.25, 1e-4
TOKEN = re.compile(r"\S+")
_SHAPE = [(re.compile("[A-ZÀ-ÖØ-Þ]+"), "A"), (re.compile("[a-zß-öø-ÿ]+"), "a"), (re.compile("[0-9]+"), "9")]


def shape_of(token: str) -> str:
    for pattern, letter in _SHAPE:
        token = pattern.sub(letter, token)
    return token[:6]


class Tokens(dict):
    """Slot of a token's word in the lower bits, of its shape in the upper; remembered while there is room."""

    def __missing__(self, token: str) -> int:
        if len(self) > 300_000:
            self.clear()
        word = zlib.crc32(token.lower().encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        shape = zlib.crc32(b"shape:" + shape_of(token).encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)
        self[token] = value = word | shape << BITS
        return value


_tokens = Tokens()  # a worker process keeps it over batches
REPEAT = (1 << BITS) - 1


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Slots and values of a text."""
    tokens = TOKEN.findall(text or "")
    if not tokens:
        return np.empty(0, np.int32), np.empty(0, np.float32)
    both = np.fromiter(map(_tokens.__getitem__, tokens), np.int64, len(tokens))
    words, shapes = both & ((1 << BITS) - 1), both >> BITS
    pairs = (shapes[:-1] * 31 + shapes[1:] * 7 + 3) & ((1 << BITS) - 1)
    again = np.full(int((words[1:] == words[:-1]).sum()), REPEAT)
    every = np.concatenate([words, shapes, pairs, again]).astype(np.uint16)
    every.sort(kind="stable")  # a radix sort for 16 bits
    ends = np.append(np.flatnonzero(every[1:] != every[:-1]), len(every) - 1)
    return every[ends].astype(np.int32), np.sqrt(np.diff(ends, prepend=-1) / len(tokens)).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, k: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) for grades 0..k-1 by Adam on the cumulative-link likelihood.

    Thresholds are a first value and exponentials of the steps between them, so they stay ordered.
    """
    row = np.repeat(np.arange(len(rows)), [len(s) for s, _ in rows])
    slot = np.concatenate([s for s, _ in rows]) if rows else np.empty(0, np.int32)
    value = np.concatenate([v for _, v in rows]) if rows else np.empty(0, np.float32)
    w = np.zeros(1 << BITS)
    share = np.array([max(1e-3, (grades >= j).mean()) for j in range(1, k)])
    first = -np.log(share[0] / (1 - min(share[0], 0.999)))
    raw = np.concatenate([[first], np.zeros(k - 2)])
    params, m, v = [w, raw], [np.zeros_like(w), np.zeros_like(raw)], [np.zeros_like(w), np.zeros_like(raw)]
    for step in range(1, steps + 1):
        cuts = np.concatenate([[params[1][0]], params[1][0] + np.cumsum(np.exp(params[1][1:]))])
        score = np.bincount(row, weights=value * params[0][slot], minlength=len(rows))
        tail = _sigmoid(score[:, None] - cuts[None, :])  # P(grade >= j) for j = 1..k-1
        ends = np.hstack([np.ones((len(rows), 1)), tail, np.zeros((len(rows), 1))])
        i = np.arange(len(rows))
        own = np.maximum(ends[i, grades] - ends[i, grades + 1], 1e-9)
        slope = np.hstack([np.zeros((len(rows), 1)), tail * (1 - tail), np.zeros((len(rows), 1))])
        d_score = (slope[i, grades] - slope[i, grades + 1]) / own
        d_cuts = np.zeros((len(rows), k + 1))
        d_cuts[i, grades] -= slope[i, grades] / own
        d_cuts[i, grades + 1] += slope[i, grades + 1] / own
        by_cut = d_cuts[:, 1:k].mean(axis=0)
        g_raw = np.concatenate([[by_cut.sum()], [by_cut[j:].sum() * np.exp(params[1][j]) for j in range(1, k - 1)]])
        g_w = np.bincount(slot, weights=value * d_score[row], minlength=1 << BITS) / max(1, len(rows)) - RIDGE * params[0]
        for p, g, a, b in zip(params, (g_w, g_raw), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p += RATE * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return params[0], np.concatenate([[params[1][0]], params[1][0] + np.cumsum(np.exp(params[1][1:]))])


def learn(docs: DataFrame, ratings: DataFrame, grade: Column, sample: int = SAMPLE) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of grades, weights, thresholds) from ratings (doc_id and a whole-number grade from 0)."""
    known = ratings.select("doc_id", grade.cast("int").alias("label")).where("label >= 0")
    top, kinds = known.agg(F.max("label"), F.countDistinct("label")).first()
    if kinds < 2:
        return (0 if top is None else top + 1), np.zeros(1 << BITS), np.empty(0)
    k = top + 1
    taught, _ = teaching_rows(bounded_batches(docs), known, sample, SHARD_ROWS)

    def shard_fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["text", "label"])
        w, cuts = fit([features(t) for t in rows["text"]], rows["label"].to_numpy(), k)
        slots = np.nonzero(np.abs(w) > 1e-4)[0]
        return pd.DataFrame({"slot": np.concatenate([slots, -1 - np.arange(k - 1)]), "w": np.concatenate([w[slots], cuts]), "shards": 1})

    parts = taught.groupBy("shard").applyInPandas(shard_fit, "slot long, w double, shards int").groupBy("slot").agg(F.sum("w").alias("w"), F.sum("shards").alias("n"))
    found = parts.collect()  # at most 2**BITS slots and the thresholds
    used = max((r["n"] for r in found if r["slot"] < 0), default=1)
    weights, cuts = np.zeros(1 << BITS), np.zeros(k - 1)
    for r in found:
        if r["slot"] < 0:
            cuts[-1 - r["slot"]] = r["w"] / used
        else:
            weights[r["slot"]] = r["w"] / used
    return k, weights, cuts


def graded(docs: DataFrame, model: tuple[int, np.ndarray, np.ndarray]) -> Column:
    """A struct expected_grade, tail (P(grade >= 1), P(grade >= 2), ...) for each text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("expected_grade double, tail array<double>")
    def grade(texts: pd.Series) -> pd.DataFrame:
        k, w, cuts = sent.value
        if not len(cuts):
            return pd.DataFrame({"expected_grade": float(max(0, k - 1)), "tail": [[1.0] * max(0, k - 1)] * len(texts)}, index=texts.index)
        score = np.array([float(v @ w[s]) for s, v in map(features, texts)])
        tail = _sigmoid(score[:, None] - cuts[None, :])
        return pd.DataFrame({"expected_grade": tail.sum(axis=1), "tail": list(tail)})

    return grade(F.col("text"))


THREE_GRADES = "case when quality = 0 then 0 when quality = 1 and toxic = 1 then 1 when quality = 1 and toxic = 0 then 2 end"


def quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, expected_grade, tail_good (P(grade >= 1)), tail_best (the highest grade's), keep.

    Learned only from documents that aren't held out; ``keep`` marks those that more likely than not are of grade 1 or more.
    """
    held_out = id_bucket(F.col("doc_id"), 3) == 1
    model = learn(docs.where(~held_out), labels.where(~held_out), F.expr(THREE_GRADES), sample)
    scored = bounded_batches(docs).select("doc_id", held_out.alias("held_out"), graded(docs, model).alias("g"))
    first, last = F.coalesce(F.get("g.tail", F.lit(0)), F.lit(0.0)), F.coalesce(F.get("g.tail", F.size("g.tail") - 1), F.lit(0.0))
    return scored.select("doc_id", "held_out", "g.expected_grade", first.alias("tail_good"), last.alias("tail_best"), (first >= 0.5).alias("keep"))
