"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A byte-level BPE never merges across pre-tokens, so a document's count is the sum over its pre-tokens. A tree keeps
leaves of about ``LEAF`` pre-tokens with their characters and tokens, and the sums of both for every subtree. An edit
finds its leaf from the root, goes back to a boundary that the edit can't have moved, splits and encodes from there
until a boundary of an untouched leaf is met again, and updates the sums on the paths of the leaves in between. The
rest of the document is neither read nor encoded.

Trees are columns (two arrays of whole numbers), so they are stored with the documents, and edits arrive as a table that
is grouped by document and joined to it. The vocabulary is read once on the driver (its path is a parameter, its size
that of a vocabulary file) and broadcast.

Defined results: a null text counts as empty and has no tokens; edits are applied by position from the last to the
first, ends cut off at the next edit's start, positions outside the text moved to its nearest end; an edit without
replacement deletes; edits of unknown documents are ignored; repeated rows are edited alike; edits at one place are
applied in order of their ends, then of their texts, the last first; an empty table gives no rows; a very long text has a
deeper tree and is held whole once, beside 16 bytes for each leaf; columns beside doc_id and text are dropped, whatever
their names.
"""

from __future__ import annotations

import base64

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanwise.llm.common import bounded_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
LEAF = 64
# Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: How far beyond its end a pre-token's match may have looked, in characters.
LOOKAHEAD = 2


class Counter(dict):
    """Tokens of a pre-token, remembered while there is room."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.encoding = tiktoken.Encoding("counts", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = len(self.encoding.encode_ordinary(piece))
        if len(self) > 400_000:
            self.clear()
        self[piece] = n
        return n

    def count(self, pieces: list[str]) -> int:
        return sum(map(self.__getitem__, pieces))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Tree:
    """Characters and tokens of the leaves of one document, as two heaps of sums (the root is 1, leaves start at m)."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        self.chars, self.tokens = chars, tokens
        self.m = len(chars) // 2

    @classmethod
    def of_leaves(cls, chars: list[int], tokens: list[int]) -> Tree:
        m = 1 << max(0, len(chars) - 1).bit_length()
        both = np.zeros((2, 2 * m), np.int64)
        both[0, m : m + len(chars)], both[1, m : m + len(tokens)] = chars, tokens
        while m > 1:
            both[:, m // 2 : m] = both[:, m : 2 * m : 2] + both[:, m + 1 : 2 * m : 2]
            m //= 2
        return cls(both[0], both[1])

    @classmethod
    def of_text(cls, text: str, counter: Counter) -> Tree:
        pieces = counter.split.findall(text)
        leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
        return cls.of_leaves([sum(map(len, x)) for x in leaves], [counter.count(x) for x in leaves])

    def find(self, position: int) -> tuple[int, int]:
        """(leaf, its first character) of the last leaf that starts at or before the position and isn't empty."""
        v, start = 1, 0
        while v < self.m:
            v *= 2
            if position >= start + self.chars[v] and self.chars[v + 1]:
                start += int(self.chars[v])
                v += 1
        return v - self.m, start

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        v = leaf + self.m
        self.chars[v], self.tokens[v] = chars, tokens
        while v > 1:
            v //= 2
            self.chars[v] = self.chars[2 * v] + self.chars[2 * v + 1]
            self.tokens[v] = self.tokens[2 * v] + self.tokens[2 * v + 1]

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, int]:
        """The edited text, and how many of its characters were encoded again."""
        leaf, at = self.find(start)
        while at and at + LOOKAHEAD > start:  # a match before this boundary may have seen what changes
            leaf, at = self.find(at - 1)
        changed = text[:start] + new + text[end:]
        moved = len(changed) - len(text)
        stop, stop_at = leaf, at  # the leaf that the scan must meet at its start to be in step again
        pieces, here = [], at
        for match in counter.split.finditer(changed, at):
            while stop < self.m and (stop_at < end or stop_at + moved < here or stop == leaf):
                stop_at += int(self.chars[stop + self.m])
                stop += 1
            if stop < self.m and stop_at + moved == here and stop_at < len(text):
                break
            pieces.append(match[0])
            here = match.end()
        else:
            stop = self.m
        slots = stop - leaf
        size = -(-len(pieces) // slots)
        if size > 4 * LEAF:  # too full: the leaves are laid out anew, from their counts
            leaves = [pieces[i : i + LEAF] for i in range(0, len(pieces), LEAF)]
            chars = [*self.chars[self.m : self.m + leaf].tolist(), *(sum(map(len, x)) for x in leaves), *self.chars[self.m + stop :].tolist()]
            tokens = [*self.tokens[self.m : self.m + leaf].tolist(), *map(counter.count, leaves), *self.tokens[self.m + stop :].tolist()]
            kept = [i for i, n in enumerate(chars) if n]
            laid = Tree.of_leaves([chars[i] for i in kept], [tokens[i] for i in kept])
            self.chars, self.tokens, self.m = laid.chars, laid.tokens, laid.m
        else:
            for i in range(slots):
                part = pieces[i * size : (i + 1) * size]
                if part or self.chars[leaf + i + self.m]:
                    self.set(leaf + i, sum(map(len, part)), counter.count(part))
        return changed, here - at


def apply_edits(text: str, tree: Tree, edits: list[tuple[int, int, str | None]], counter: Counter) -> tuple[str, int]:
    """The text after all edits and the characters encoded again; the tree follows."""
    again, limit = 0, len(text)
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1], e[2] or ""), reverse=True):
        start = min(max(0, start), limit)
        end = min(max(start, end), limit)
        text, n = tree.edit(text, start, end, new or "", counter)
        again, limit = again + n, start
    return text, again


TREE = "n_tokens long, tree_chars array<int>, tree_tokens array<int>"
EDITED = f"text string, {TREE}, reencoded_chars long"


def _ranks(spark: SparkSession, path: str):
    return spark.sparkContext.broadcast(read_ranks(path))


_counters: dict[int, Counter] = {}


def _counter(ranks) -> Counter:
    """One counter for each worker process and vocabulary, so that what it remembers lasts over batches."""
    key = id(ranks.value)  # a worker keeps one value for each broadcast
    if key not in _counters:
        _counters.clear()
        _counters[key] = Counter(ranks.value)
    return _counters[key]


def token_trees(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, text, n_tokens and the tree of each document."""
    ranks = _ranks(docs.sparkSession, vocabulary)

    @F.pandas_udf(TREE)
    def build(texts: pd.Series) -> pd.DataFrame:
        counter = _counter(ranks)
        trees = [Tree.of_text(t or "", counter) for t in texts]
        return pd.DataFrame({"n_tokens": [int(t.tokens[1]) for t in trees], "tree_chars": [t.chars for t in trees], "tree_tokens": [t.tokens for t in trees]})

    return bounded_batches(docs).select("doc_id", "text", build(F.col("text")).alias("t")).select("doc_id", "text", "t.*")


def edited(trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """Trees and texts after edits (doc_id, start, end, new), for every document; what wasn't edited stays as it is."""
    grouped = edits.groupBy(F.col("doc_id").alias("__id")).agg(F.collect_list(F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.col("new").cast("string").alias("new"))).alias("edits"))
    joined = trees.join(grouped, trees["doc_id"].eqNullSafe(grouped["__id"]), "left").drop("__id")
    return edited_in_place(joined, vocabulary)


def edited_in_place(trees: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """As ``edited``, with each document's edits in an array column ``edits``."""
    ranks = _ranks(trees.sparkSession, vocabulary)

    @F.pandas_udf(EDITED)
    def edit(texts: pd.Series, chars: pd.Series, tokens: pd.Series, edits: pd.Series) -> pd.DataFrame:
        counter, rows = _counter(ranks), []
        for t, c, n, e in zip(texts, chars, tokens, edits, strict=True):
            tree = Tree(np.array(c, np.int64), np.array(n, np.int64))
            t, again = (t, 0) if e is None or not len(e) else apply_edits(t or "", tree, [(x["start"], x["end"], x["new"]) for x in e], counter)
            rows.append((t, int(tree.tokens[1]), tree.chars, tree.tokens, again))
        return pd.DataFrame(rows, columns=["text", "n_tokens", "tree_chars", "tree_tokens", "reencoded_chars"])

    done = bounded_batches(trees).select("doc_id", F.col("n_tokens").alias("n_tokens_before"), edit("text", "tree_chars", "tree_tokens", "edits").alias("e"))
    return done.select("doc_id", "n_tokens_before", "e.*")


def two_edits(docs: DataFrame) -> DataFrame:
    """For the query: an insertion and a deletion at places that follow from the id, for every document, as a column."""
    n, spot = F.length(F.coalesce("text", F.lit(""))), lambda salt: F.pmod(F.xxhash64(F.lit(salt), "doc_id"), F.length(F.coalesce("text", F.lit(""))) + 1).cast("int")
    insert = F.struct(spot(1).alias("start"), spot(1).alias("end"), F.concat(F.lit(" (revised "), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(") ")).alias("new"))
    delete = F.struct(spot(2).alias("start"), F.least(spot(2) + 25, n).alias("end"), F.lit("").alias("new"))
    return docs.withColumn("edits", F.array(insert, delete))


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_tokens_edited, edited_chars, reencoded_chars: counts before and after the two edits."""
    after = edited_in_place(two_edits(token_trees(docs, vocabulary)), vocabulary)
    return after.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), F.length("text").cast("long").alias("edited_chars"), "reencoded_chars")
