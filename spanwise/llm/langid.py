"""Language identification: script ranges narrow the candidates, a Viterbi path with a switching penalty labels spans.

Training counts, for each language, words and the character trigrams of its words (with word ends) in Spark: one pass,
partial aggregation, then the model is read off two small tables. It is fitted on at most about ``SAMPLE`` documents of
each language, taken by a hash of the id so that the same documents come back on every run; that is the only bound.
The model that tasks receive holds the words that the sample has ``LEAST_COUNT`` times or more and 2**``TRIGRAM_BITS``
hashed trigrams, so the sample bounds it whatever the size of the corpus. ``documents`` is read three times: its
languages alone (to set the sample's share), the sample, and every text for its prediction.

Scoring: each distinct word of a batch gets a log-likelihood under every language, from its word count where known and
from its trigrams otherwise; letters' script ranges rule out languages that are never written in that script. The path
over a document's words maximises the sum of scores minus ``SWITCH`` for each change of language; documents of a batch
are walked side by side, so the time steps are vectorised over documents. The prediction is the language that labels
most letters, its score the share of letters that it labels.

Defined results: a null text or one without letters is ``und`` with score 0; documents with a null language aren't
learned from; with nothing to learn from, every document is ``und``; equal shares go to the smallest name; repeated rows
give repeated results; an empty table gives no rows; a very long text is labelled whole, at 4 bytes for each language
and different word and an eighth of a byte for each language and word; any number of languages is told apart; columns beside doc_id, text and lang are ignored here and kept by the pipeline's stage,
whatever their names.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanwise.functions.lineage import cut_lineage
from spanwise.llm.common import bounded_batches, fresh, id_bucket

SAMPLE, LEAST_COUNT, TRIGRAM_BITS = 1500, 3, 15
BLOCK = 1 << 19  # words times languages whose scores are worked on at a time
PATH_WORDS = 2_000_000  # words of the documents that are walked side by side
SWITCH = 12.0  # in nats: a span of another language must gain this much to be worth leaving and coming back for
STRENGTH, CLIP = 0.5, 6.0
WORD = re.compile(r"[^\W\d_]+")

# First code points of script blocks, and the script from there on.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0700, "other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "other"), (0x0B80, "Tamil"), (0x0C00, "other"),
    (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"),
    (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"), (0x3100, "other"), (0x3400, "Han"), (0xA000, "other"),
    (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB1D, "Hebrew"), (0xFB50, "Arabic"),
    (0xFE00, "other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "other"), (0x20000, "Han"),
]
_STARTS = np.array([s for s, _ in SCRIPTS])


def trigram_slots(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed trigrams of non-empty words with their ends marked: the slots of all words in a row, how many each word
    has (as many as letters), and the script of each word's first letter as an index into ``SCRIPTS``."""
    codes = np.frombuffer(("^" + "$^".join(words) + "$").encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(n + 2) - n - 2
    at = np.arange(n.sum()) + np.repeat(2 * np.arange(len(words)), n)
    value = (codes[at] * np.uint32(0x9E3779B1) ^ codes[at + 1] * np.uint32(0x85EBCA77)) + codes[at + 2] * np.uint32(0xC2B2AE3D)
    value ^= value >> np.uint32(15)
    return (value * np.uint32(0x27D4EB2F) >> np.uint32(32 - TRIGRAM_BITS)).astype(np.int64), n, np.searchsorted(_STARTS, codes[first + 1], side="right") - 1


class Model:
    """Languages, their scripts, word and trigram log-likelihoods; picklable, of bounded size."""

    def __init__(self, languages: list[str], scripts: dict[str, list[int]], words: dict[str, np.ndarray], trigrams: np.ndarray):
        self.languages, self.scripts, self.words, self.trigrams = languages, scripts, words, trigrams
        self.barred = np.zeros((len(SCRIPTS), len(languages)), np.float32)
        for i, (_, name) in enumerate(SCRIPTS):
            if name in scripts and 0 < len(scripts[name]) < len(languages):
                self.barred[i] = -4 * CLIP
                self.barred[i, scripts[name]] = 0

    def of_words(self, words: list[str]) -> np.ndarray:
        """Log-likelihood of each word under each language, relative to its best one."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        step = max(1, BLOCK // len(self.languages)) if self.languages else 1
        for i in range(0, len(words), step):
            out[i : i + step] = self._of_block(words[i : i + step])
        return out

    def _of_block(self, words: list[str]) -> np.ndarray:
        slots, n, script = trigram_slots(words)
        table = np.zeros((len(words), len(self.languages)), np.float32)
        ends, most, i = np.cumsum(n), max(1, BLOCK // max(1, len(self.languages))), 0
        while i < len(words):  # words of at most ``most`` trigrams together, or one word in pieces
            first = int(ends[i] - n[i])
            j = max(i + 1, int(np.searchsorted(ends, first + most, side="right")))
            if n[i] > most:
                table[i] = sum(self.trigrams[slots[c : min(c + most, ends[i])]].sum(axis=0) for c in range(first, int(ends[i]), most))
            else:
                table[i:j] = np.add.reduceat(self.trigrams[slots[first : ends[j - 1]]], ends[i:j] - n[i:j] - first, axis=0)
            i = j
        table *= np.float32(STRENGTH)
        for i, v in enumerate(map(self.words.get, words)):
            if v is not None:
                table[i] = v
        return np.clip(table - table.max(axis=1, keepdims=True), -CLIP, 0) + self.barred[script]

    def spans(self, texts: list[str | None]) -> list[tuple[list[str], np.ndarray]]:
        """Words and the language index of each, for every text."""
        words = [WORD.findall((t or "").lower()) for t in texts]
        words = [w if any(map(str.isalpha, w)) or any(c.isalpha() for x in w for c in x) else [] for w in words]
        distinct = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        table = self.of_words(list(distinct))
        labels: list[np.ndarray] = []
        hard: list[tuple[int, np.ndarray]] = []
        for i, d in enumerate(words):
            ids = np.fromiter(map(distinct.__getitem__, d), np.int64, len(d))
            labels.append(self._in_one(ids, table))
            if labels[-1] is None:
                hard.append((i, ids))
        hard.sort(key=lambda x: -len(x[1]))
        at = 0
        while at < len(hard):
            part = hard[at : at + max(1, min(512, PATH_WORDS // len(hard[at][1])))]  # bounds the paths' memory
            at += len(part)
            for (i, _), path in zip(part, self._paths([ids for _, ids in part], table), strict=True):
                labels[i] = path
        return list(zip(words, labels, strict=True))

    def _in_one(self, ids: np.ndarray, table: np.ndarray) -> np.ndarray | None:
        """A path in a single language where that provably is the best one, else None.

        Of j spans of other languages, a path that visits the language pays for j changes at least; each must gain a
        change to be worth it. One that never visits it pays for j - 1 only, but its first span starts the text and its
        last one ends it: with other spans below a change, these two must gain a change together. (With j = 1 it is a
        single language, and no other has more.)
        """
        k = len(self.languages)
        step = max(1, BLOCK // max(1, k))  # words at a time: sums and least sums so far are carried on
        blocks = [slice(i, i + step) for i in range(0, len(ids), step)]
        total = sum((table[ids[b]].sum(axis=0, dtype=np.float64) for b in blocks), np.zeros(k))
        best = int(total.argmax()) if len(ids) else 0
        so_far, least, most, span = np.zeros(k), np.zeros(k), -np.inf, -np.inf
        for b in blocks:
            scores = table[ids[b]]
            ahead = np.empty((len(scores) + 1, k))
            ahead[0] = so_far
            np.subtract(scores, scores[:, best : best + 1], out=ahead[1:])
            np.cumsum(ahead, axis=0, out=ahead)
            low = np.minimum(np.minimum.accumulate(ahead[:-1], axis=0), least)
            span, most = max(span, (ahead[1:] - low).max()), max(most, ahead[1:].max())
            so_far, least = ahead[-1], low[-1]
        if len(ids) and max(span, most + (so_far - least).max()) >= SWITCH:
            return None
        return np.full(len(ids), best, np.int32)

    def _paths(self, ids: list[np.ndarray], table: np.ndarray) -> list[np.ndarray]:
        """Viterbi over documents sorted from long to short: at step t those with more than t words are a prefix.

        A change costs the same wherever it leads, so a step remembers the best language to come from and one bit for each
        language that is better stayed in.
        """
        k, lengths = len(self.languages), np.array([len(d) for d in ids])
        active = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(lengths[0])]
        by_step = np.concatenate(ids)[np.argsort(np.concatenate([np.arange(n) for n in lengths]), kind="stable")]
        value, at = np.zeros((len(ids), k), np.float32), 0
        bests, stays = np.zeros(len(by_step), np.int32), np.zeros((len(by_step), -(-k // 8)), np.uint8)
        for t, n in enumerate(active):
            if t:
                best = value[:n].argmax(axis=1)
                leave = value[np.arange(n), best][:, None] - np.float32(SWITCH)
                stay = value[:n] >= leave
                bests[at : at + n], stays[at : at + n] = best, np.packbits(stay, axis=1)
                value[:n] = np.where(stay, value[:n], leave)
            value[:n] += table[by_step[at : at + n]]
            at += n
        state = value.argmax(axis=1).astype(np.int32)
        trail = np.zeros((lengths[0], len(ids)), np.int32)
        for t in range(lengths[0] - 1, -1, -1):
            n = active[t]
            at -= n
            trail[t, :n] = state[:n]
            if t:
                best, stay = bests[at : at + n], stays[at : at + n]
                stayed = stay[np.arange(n), state[:n] >> 3] >> (7 - (state[:n] & 7)) & 1
                state[:n] = np.where(stayed == 1, state[:n], best)
        return [trail[:n, d].copy() for d, n in enumerate(lengths)]

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for words, path in self.spans(texts):
            if not words:
                out.append(("und", 0.0))
                continue
            weight = np.bincount(path, weights=[len(w) for w in words], minlength=len(self.languages))
            top = int(weight.argmax())
            out.append((self.languages[top], float(weight[top] / weight.sum())))
        return out


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits the model on rows with text and lang."""
    spoken = bounded_batches(docs).where("lang is not null")
    counts = {r["lang"]: r["n"] for r in spoken.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}  # reads no text
    languages = sorted(counts)
    if not languages:
        return Model([], {}, {}, np.zeros((1 << TRIGRAM_BITS, 0), np.float32))
    grain = 1 << 30
    share = F.coalesce(*[F.when(F.col("lang") == n, F.lit(min(grain, grain * sample // counts[n]))) for n in languages])
    chosen = spoken.where(F.pmod(F.xxhash64("doc_id"), F.lit(grain)) < share).where("text is not null").select("lang", "text")

    def counted(batches):
        for batch in batches:
            found: dict[tuple[str, str], int] = {}
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                for w in WORD.findall(text.lower()):
                    found[lang, w] = found.get((lang, w), 0) + 1
            yield pd.DataFrame([(a, w, n) for (a, w), n in found.items()], columns=["lang", "word", "n"])

    words = chosen.mapInPandas(counted, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by_language = [F.sum(F.when(F.col("lang") == x, F.col("n")).otherwise(0)).alias(f"n{i}") for i, x in enumerate(languages)]
    wide = cut_lineage(words.groupBy("word").agg(F.sum("n").alias("n"), *by_language))  # of bounded size, and read twice below

    def slots(batches):
        for batch in batches:
            total = np.zeros((1 << TRIGRAM_BITS, len(languages)), np.int64)
            values = batch[[f"n{i}" for i in range(len(languages))]].to_numpy(np.int64)
            scripts: dict[str, np.ndarray] = {}
            if len(batch):
                found, n, script = trigram_slots(batch["word"].tolist())
                np.add.at(total, found, np.repeat(values, n, axis=0))
                for s in np.unique(script):
                    name = SCRIPTS[s][1]
                    scripts[name] = scripts.get(name, 0) + values[script == s].sum(axis=0)
            rows = [(str(i), *total[i].tolist()) for i in np.nonzero(total.any(axis=1))[0]] + [(s, *v.tolist()) for s, v in scripts.items()]
            yield pd.DataFrame(rows, columns=["slot", *[f"n{i}" for i in range(len(languages))]])

    cols = ", ".join(f"n{i} long" for i in range(len(languages)))
    sums = [F.sum(f"n{i}").alias(f"n{i}") for i in range(len(languages))]
    tables = wide.mapInPandas(slots, f"slot string, {cols}").groupBy("slot").agg(*sums).collect()  # 2**15 slots and the scripts
    known = wide.where(F.col("n") >= LEAST_COUNT).collect()  # bounded by the sample

    trigrams = np.full((1 << TRIGRAM_BITS, len(languages)), 0.2)
    scripts: dict[str, list[int]] = {}
    by_script = {r["slot"]: np.array(r[1:], float) for r in tables if not r["slot"].isdigit()}
    totals = sum(by_script.values())
    for s, v in by_script.items():
        scripts[s] = [i for i in range(len(languages)) if v[i] >= 0.01 * max(1.0, totals[i])]
    for r in tables:
        if r["slot"].isdigit():
            trigrams[int(r["slot"])] += r[1:]
    trigrams = np.log(trigrams / trigrams.sum(axis=0)).astype(np.float32)
    vocabulary = {r["word"]: np.log((np.array(r[2:], float) + 0.3) / (totals + 0.3 * len(known))) for r in known}
    return Model(languages, scripts, {w: v.astype(np.float32) for w, v in vocabulary.items()}, trigrams)


def predicted(docs: DataFrame, model: Model) -> Column:
    """A struct lang_pred, score for each text of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for i in range(0, len(texts), 1024):
            part = texts.iloc[i : i + 1024].tolist()
            rows += sent.value.predict(part) if sent.value.languages else [("und", 0.0)] * len(part)
        return pd.DataFrame(rows, columns=["lang_pred", "score"])

    return predict(F.col("text"))


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned only from documents that aren't held out."""
    held_out = id_bucket(F.col("doc_id"), 4) == 2
    model = learn(docs.where(~held_out), sample)
    return docs.select("doc_id", held_out.alias("held_out"), predicted(docs, model).alias("p")).select("doc_id", "held_out", "p.*")


def keep_identified(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Documents with a language, in however many languages they are; columns stay as they are."""
    model = learn(docs.where(id_bucket(F.col("doc_id"), 4) != 2), sample)
    said = fresh(docs, "said")
    named = docs.withColumn(said, predicted(docs, model))
    return named.where(F.col(f"{said}.lang_pred") != "und").drop(said)
